"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows,
empty tables and further columns whose names clash with those used inside."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat, ledger, minhash, phrases, pieces, secrets_cnn, shards, templates, token_files, toxicity

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """Rows (doc_id, text) with columns that clash with names used inside the operators."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket long, anchor string, h string, part long, tag long, component string, n_words string"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, "x", "x", 0, 0, "x", "x") for i, t in rows], schema)


def mixed_texts(seed=3):
    rng = random.Random(seed)
    voc = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(voc) for _ in range(90)) for _ in range(4)]
    rows = []
    for b in base:
        for _ in range(5):
            words = b.split()
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(voc)
            rows.append(" ".join(words))
    shared = " ".join(voc[:30])
    rows += [" ".join(rng.choice(voc) for _ in range(20)) + " " + shared + "\n" + shared for _ in range(4)]
    rows += ["", " \t\n", "one", "One", "a b c", "A  b\tc", None, None, "x " * 3000, "x " * 3000]
    numbered = list(enumerate(rows))
    return numbered + [numbered[2], numbered[25]]


EMPTY = []


# --- 1 -------------------------------------------------------------------------


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = mixed_texts() + [(None, "a null id"), (None, None), (900, "<|endoftext|> It's ,.% É***"), (901, "Σας 日本 \x1c é́")]
    tok = Tokenizer.from_file(path)
    got = token_files.round_trip(documents(spark, rows), path).collect()
    want = sorted((i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [tok.encode(t or "", add_special_tokens=False).ids + [2]])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.round_trip(documents(spark, EMPTY), path).count() == 0


def test_other_tokenizer_files_take_whole_texts(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rows = mixed_texts()[:12] + [(900, "Hello big world"), (901, " It's\n\n ,.%"), (902, None)]
    tok = Tokenizer.from_file(path)
    want = sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [tok.encode(t or "", add_special_tokens=False).ids + [2]])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(documents(spark, rows), path).collect()) == want


@pytest.mark.parametrize("weights", [[1], [5, 1], [2**i for i in range(40)], [7] * 300, [1000, 1, 1, 1, 50, 3]])
def test_code_is_canonical_limited_and_decodes(weights):
    counts = np.array([0, *weights, 0])
    lengths = token_files.code_lengths(counts)
    assert lengths.max() <= token_files.LIMIT and ((lengths > 0) == (counts > 0)).all()
    if len(weights) > 1:
        assert sum(2.0 ** -int(n) for n in lengths if n) == 1.0
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 3000)
    bits, marks = token_files.packed(ids, lengths, token_files.code_words(lengths))
    assert (token_files.unpacked([(bits, marks, len(ids))], token_files.decoding_table(lengths)) == ids).all()


# --- 2 -------------------------------------------------------------------------


def test_shards_grow_only_into_the_new_one(spark):
    rows = [(i, f"t{i % 7}") for i in range(4000)] + [(None, "x"), (None, None), (5, "t5")]
    got = shards.shard_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.25 * min(map(len, slots.values()))
    assert 0.07 < sum(r["grown_shard"] == 8 for r in got) / len(got) < 0.16
    by_id = {}
    for r in got:
        assert by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 5} == {(3, zlib.crc32(b"t5"))}
    assert shards.shard_documents(documents(spark, EMPTY)).count() == 0


def test_changed_weights_move_rows_only_near_them(spark):
    tree = shards.balanced_tree()
    heavy = [shards.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 1 else 1.0) for x in tree]
    rows = shards.place(shards.place(spark.range(3000), tree, "id", "a"), heavy, "id", "b").collect()
    moved = [r for r in rows if r["a"] != r["b"]]
    assert moved and all(r["b"] in (0, 1, 2, 3) for r in moved)
    assert not any(r["a"] in (4, 5, 6, 7) and r["b"] in (4, 5, 6, 7) for r in moved)


# --- 3 -------------------------------------------------------------------------


def test_templates_catch_new_parameters_and_reject_mixed_slots(spark):
    item = "If John has 12 apples and gives Mary 5 kg of them, then how many does John keep after 3 days with Mary?"
    bench = spark.createDataFrame([(1, item, "x"), (2, "the cat sat", "x"), (3, None, "x"), (None, item, "x"), (4, "", "x")], "item_id long, text string, doc_id string")
    other = "if {0} has 7 apples and gives {1} 9 km of them, then how many does {2} keep after 4 weeks with {3}?"
    rows = [
        (1, "Well known: " + item + " Yes."),
        (2, (other.format("Peter", "Ann", "Peter", "Ann") + " ") * 2),
        (3, "The cat sat."),
        (4, "The cat sat on the mat"),
        (5, None),
        (6, ""),
        (None, item),
        (7, "word " * 5000),
        (8, " ".join(item.split()[:9])),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in templates.leaks(documents(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2)}
    assert got[1, 1]["n_changed"] == 0 and got[2, 1]["n_changed"] > 0 and got[2, 1]["n_consistent"] == got[2, 1]["n_slots"]
    kept = templates.decontaminated(documents(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6, None, 7, 8} and kept.columns == documents(spark, rows).columns
    assert templates.leaks(documents(spark, EMPTY), bench).count() == 0
    assert templates.leaks(documents(spark, rows), bench.limit(0)).count() == 0


def test_slots_that_disagree_are_no_leak(spark):
    bench = spark.createDataFrame([(1, "so 2 and then 2 or maybe 2 with just 2 plus the 2 we had")], "item_id long, text string")
    rows = [(1, "so 9 and then 9 or maybe 9 with just 9 plus the 9 we had"), (2, "so 1 and then 4 or maybe 5 with just 6 plus the 7 we had")]
    assert {r["doc_id"] for r in templates.leaks(documents(spark, rows), bench).collect()} == {1}


def test_names_that_open_sentences_and_capitals_are_caught(spark):
    item = "Anna has 3 apples. Anna buys 5 more. Anna eats 2 of them. Anna then sells the rest to her old friend."
    title = "the long way to the river goes past Old Mill Lane and then turns left at the red barn"
    bench = spark.createDataFrame([(1, item), (2, title)], "item_id long, text string")
    rows = [
        (1, item.replace("Anna", "Tom").replace("3", "7").replace("5", "9")),
        (2, title.title()),
        (3, title.upper()),
        (4, "Yesterday " + item),
        (5, "Tom has 3 pears. Ben sees 5 dogs. Kim likes 2 of these. Sue then paints the rest of her own house."),
        (6, item.replace("Anna", "Tom", 1).replace("Anna", "Ben", 1).replace("Anna", "Kim", 1).replace("Anna", "Sue", 1)),
    ]
    got = [(r["doc_id"], r["item_id"]) for r in templates.leaks(documents(spark, rows), bench).collect()]
    assert sorted(got) == [(1, 1), (2, 2), (3, 2), (4, 1)]


# --- 4 -------------------------------------------------------------------------


def test_chat_digest_and_escapes(spark):
    odd = "a </s> <\\s> <\\\\s> [INST] [\\/INST] <|im_end|>\n<|im_start|>user\nb <<SYS>> \\ % é\U0001f600 $1"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", None), (2, None, "a%0A\n<b", ""), (2, 5, None, "x"), (None, 0, "assistant", "y"), (3, 0, "assistant", "<" * 50), (3, 0, "assistant", "<" * 50)]
    table = spark.createDataFrame([(*r, "k", 0) for r in rows], "conv_id long, turn long, role string, text string, kind string, seq long")
    out = chat.formatted_conversations(table)
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    rows = rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    lengths = {r["conv_id"]: len(r["formatted"]) for r in out.collect()}
    assert {k: g["formatted_chars"] for k, g in got.items()} == lengths
    for r in out.collect():
        assert r["formatted"].count("<|im_start|>") == got[r["conv_id"]]["n_turns"]


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "delta", 2, "assistant", "he"), (1, 3, "delta", 2, "assistant", "llo"),
        (1, 4, "message", 3, "user", "more"), (1, 5, "regenerate", 2, "assistant", None), (1, 6, "delta", 2, "assistant", "bye"),
        (1, 7, "edit", 1, "user", "hey"), (2, 1, "delta", 1, "user", "a"), (2, 2, "edit", 1, "user", "b"), (2, 3, "delta", 1, "user", "c"),
    ]
    rows = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"], r["text"]) for r in rows} == {(1, 1, "hey"), (1, 2, "bye"), (2, 1, "bc")}


# --- 5 -------------------------------------------------------------------------


def slow_repeats(rows):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    rank = lambda i: -1 if i is None else i
    for i, w in words:
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            first[k] = min(first.get(k, (rank(i), p)), (rank(i), p))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < (rank(i), p):
                gone.update(range(p, p + 20))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((rank(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [phrases.HOT, 0])
def test_repeated_passages_match_brute_force(spark, hot):
    rows = mixed_texts() + [(None, mixed_texts()[0][1]), (950, mixed_texts()[1][1] + " x" * 25)]
    docs = documents(spark, rows).repartition(7, "n_chars")  # several slices
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrases.repeats(docs, hot).collect())
    assert got == slow_repeats(rows) and any(r[2] for r in got)
    assert phrases.repeats(documents(spark, EMPTY), hot).count() == 0


def test_automaton_finds_every_occurrence():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 4, 3000)
    words[500:540], words[1500:1540] = words[100:140], words[110:150]
    text = phrases._lettered(words)
    wanted = [text[100 + i : 100 + i + phrases.WINDOW] for i in range(20)]
    at, number = phrases.occurrences(text, wanted)
    assert sorted(zip(at.tolist(), number.tolist(), strict=True)) == sorted((i, n) for n, p in enumerate(wanted) for i in range(len(text)) if text.startswith(p, i))


def test_shards_end_between_anchors_and_give_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [{"anchor": a, "doc_id": d, "tag": 0, "pos": 100 * a, "mask": (1 << 11) - 1, "words": np.arange(a, a + 30, dtype="<u4").tobytes()} for a in range(60) for d in rng.permutation(5)[: 1 + a % 5].tolist()]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32()), ("mask", pa.int32()), ("words", pa.binary())]))
    want = None
    for shard in (10_000, 40, 1):
        monkeypatch.setattr(phrases, "SHARD", shard)
        out = list(phrases._located(iter([batch.slice(0, 71), batch.slice(71, 1), batch.slice(72)])))
        got = sorted((r["pos"], r["doc_id"], r["mask"]) for b in out for r in b.to_pylist())
        # Windows of neighbouring anchors overlap, but only pieces of one anchor are compared in a shard of one.
        want = want or got
        assert (len(out) == 1) == (shard == 10_000) and len(got) <= len(want)
    assert {(r["pos"], r["doc_id"]) for r in rows if r["doc_id"] != min(x["doc_id"] for x in rows if x["anchor"] == r["anchor"])} <= {(p, d) for p, d, _ in got}


@pytest.mark.parametrize("run", [phrases._anchor_counts, phrases._anchor_places, minhash._sketched, templates._scanner("doc_id", None)])
def test_slices_of_batches_give_what_whole_batches_give(run):
    """A cut batch is a view with an offset; each scan must give the same on it as on a copy."""
    texts = [t for _, t in mixed_texts()]
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "tag": [0] * len(texts), "text": texts}, pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("text", pa.string())]))
    cut = whole.slice(7, 21)
    copy = pa.RecordBatch.from_pylist(cut.to_pylist(), cut.schema)
    assert [b.to_pydict() for b in run(iter([cut]))] == [b.to_pydict() for b in run(iter([copy]))]


def test_pieces_of_cut_batches_are_valid():
    texts = ["x " * 40, "y " * 30, None, "", "z " * 60, "one two"] * 5
    whole = pa.RecordBatch.from_pydict(
        {"doc_id": list(range(30)), "tag": [0] * 30, "no_id": [False] * 30, "text": texts, "places": [[3 << 16 | 2 << 8 | 5] if i % 3 == 1 else None for i in range(30)]},
        pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("no_id", pa.bool_()), ("text", pa.string()), ("places", pa.list_(pa.int64()))]),
    )
    long = whole.filter(pa.array([i % 6 == 1 or i % 3 == 0 for i in range(30)]))
    for first in (0, 1, 4):
        cut = long.slice(first, 7)
        copy = pa.RecordBatch.from_pylist(cut.to_pylist(), cut.schema)
        got, want = ([b.to_pydict() for b in phrases._pieces(iter([x]))] for x in (cut, copy))
        assert got == want


# --- 6 -------------------------------------------------------------------------


def test_base_findings_stay_and_the_network_recalls_made_secrets(spark):
    key = "A7x9Qm2Lk0Zr8Tn4Vb6Y"
    rows = [(1, f'Password = "{key}" é x'), (2, "token: abc secret=toolong1"), (3, "AKIA" + "Q" * 16 + " AKIAQ"), (4, "ab12" * 6 + " " + "f" * 23), (5, None), (6, ""), (7, "plain words " * 9000), (8, f"auth={key}{key} or"), (1, f'Password = "{key}" é x')]
    got = {r["doc_id"]: r for r in secrets_cnn.scanned(documents(spark, rows)).collect()}
    assert [(got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) for i in range(1, 8)] == [(1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    want = f"assign:0:{len('Password = ') + 1 + len(key)}"
    assert got[1]["spans"] == want and got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[8]["spans"].startswith("cnn:") and got[7]["spans"] == ""
    masked = {r["doc_id"]: r for r in secrets_cnn.redacted(documents(spark, rows)).collect()}
    assert key not in masked[1]["text"] and masked[1]["n_chars"] == len(masked[1]["text"]) and masked[7]["text"] == rows[6][1]
    assert secrets_cnn.scanned(documents(spark, EMPTY)).count() == 0

    net, rng = secrets_cnn.trained(), np.random.default_rng(12345)
    made = secrets_cnn.labelled_findings(600, rng)
    p = net.probabilities(np.stack([secrets_cnn.encoded(t, a, b) for t, a, b, _ in made])) >= net.threshold
    y = np.array([r[3] for r in made]) == 1
    assert p[y].mean() >= 0.9 and p[~y].mean() <= 0.05


def test_secrets_deep_inside_long_candidates_are_found():
    net, rng = secrets_cnn.trained(), np.random.default_rng(77)
    chars = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    heads = ["/usr/share/documents/manuals/letters/of/the/house/token/", "name=value_of_the_first_and_the_second_part_of_the_chain/key="]
    keys = ["".join(rng.choice(chars, 32)) for _ in range(100)]
    texts = [f"see {heads[i % 2]}{k} there" for i, k in enumerate(keys)]
    got = secrets_cnn.spans_of(pa.array(texts), net)
    assert sum(bool(s) for s in got) >= 90
    assert all(k not in secrets_cnn.masked(t, s) for k, t, s in zip(keys, texts, got) if s)
    for n in (16, 40, 41, 95, 300):
        seen = np.zeros(n, int)
        for a, b in secrets_cnn.stretches(5, 5 + n):
            seen[a - 5 : min(b, a + secrets_cnn.INSIDE) - 5] = 1
        assert seen.all()


def test_threshold_keeps_the_recall():
    rng = np.random.default_rng(7)
    rows = secrets_cnn.labelled_findings(secrets_cnn.TRAINING, rng)
    tune = rows[int(0.8 * len(rows)) :]
    net = secrets_cnn.trained()
    p = net.probabilities(np.stack([secrets_cnn.encoded(t, a, b) for t, a, b, y in tune if y]))
    assert (p >= net.threshold).mean() >= secrets_cnn.RECALL


# --- 7 -------------------------------------------------------------------------


def test_pieces_equal_the_library_and_round_trip(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    texts = [t for _, t in mixed_texts()] + [" a", "a ", "a  b   c\n\n d", "<s> </s> <0x0A>", "日本 🎉", "\x00", "...,", "Mr. e.g., a.b"]
    rows = list(enumerate(texts))
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    out = pieces.encoded(documents(spark, rows), path, with_ids=True)
    got = out.collect()
    for r in got:
        ids = lib.encode(texts[r["doc_id"]] or "")
        assert list(struct.unpack(f"<{r['n_tokens']}I", r["ids"])) == ids and r["exact"] and r["parity"] is not False
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(out.select("doc_id", "ids"), path).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert pieces.encoded(documents(spark, EMPTY), path).count() == 0


def test_every_text_is_compared_with_the_library(spark):
    rows = list(enumerate(["", "one", "two words", "日本 🎉", "a  b   c\n\n d"] + [f"text number {i}" for i in range(40)]))
    got = pieces.encoded(documents(spark, rows), P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows) and all(r["parity"] is True for r in got)


def test_unigram_models_keep_scores_and_byte_fallback():
    field = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    piece = lambda text, score, kind: field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))
    model = piece("<unk>", 0, 2) + piece("▁a", -1, 1) + piece("b", -2, 1) + piece("▁ab", -9, 1) + b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    model += field(2, bytes([3 << 3, 1, 35 << 3 & 0x7F | 0x80, 35 << 3 >> 7, 1]))
    parsed = pieces.parsed_model(model)
    assert parsed.algorithm == pieces.UNIGRAM and parsed.scores[2] == -2 and parsed.byte_fallback and parsed.unknown == 0
    assert pieces.rebuilt(parsed).encode("▁ab", add_special_tokens=False).ids == [1, 2]


def model_file(path, algorithm, rows, byte_fallback=True):
    """A model written by hand: (piece, score, kind) rows and, with byte fallback, the 256 byte pieces."""
    field = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    piece = lambda text, score, kind: field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))
    rows = list(rows) + [(f"<0x{i:02X}>", 0.0, pieces.BYTE) for i in range(256)] * byte_fallback
    data = b"".join(piece(*r) for r in rows) + field(2, bytes([3 << 3, algorithm, 35 << 3 & 0x7F | 0x80, 35 << 3 >> 7, int(byte_fallback)])) + field(3, field(1, b"identity"))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("algorithm", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("defined", [False, True])
def test_small_models_equal_the_library(tmp_path, algorithm, defined):
    import sentencepiece

    rng = random.Random(algorithm)
    rows = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    rows += [("<extra>", 0.0, pieces.USER_DEFINED), ("<ex", 0.0, pieces.USER_DEFINED)] * defined
    letters = "▁abcdeé<>/s0x41unk"
    chosen = dict.fromkeys("".join(rng.choice("abcde0") for _ in range(rng.randrange(2, 5))) for _ in range(60))
    chosen |= dict.fromkeys(["▁a", "▁ab", "▁c", "<s", "s>", "0x", "x4", "un", "nk", "<u", "</"])
    rows += [(c, -8 - rng.random(), pieces.NORMAL) for c in dict.fromkeys(letters)] + [(w, -1 - 4 * rng.random(), pieces.NORMAL) for w in chosen if len(w) > 1]
    path = model_file(tmp_path / "m.model", algorithm, rows)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["<s> x </s>", "a<unk>b", "<0x41> y", "<extra> ab<extra>c <ex d", "日本 🎉 é", "a  b\n\nc.", "", " ", "ab " * 50]
    texts += ["".join(rng.choice("abcde0é <>/s\n日") for _ in range(rng.randrange(60))) for _ in range(300)]
    c = pieces.Codec(path)
    ids, n = c.encode(pa.array(texts))
    ends = np.cumsum(n)
    got = [ids[e - k : e].tolist() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
    assert [(t, a) for t, a, b in zip(texts, got, lib.encode(texts), strict=True) if a != b] == []


# --- 8 -------------------------------------------------------------------------


def slow_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * (k := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rows = mixed_texts()
    want = slow_components(rows)
    got = minhash.linked(documents(spark, rows + [(None, rows[0][1])])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert len({c for _, c in want.values()}) < len(want)


def test_near_duplicates_of_one_large_group_match_brute_force(spark):
    rng = random.Random(11)
    voc = [f"w{i}" for i in range(3000)]
    base = [rng.choice(voc) for _ in range(100)]
    edits = [(rng.randrange(100), rng.choice(voc)) for _ in range(12)]
    rows = []
    for i in range(160):
        words = list(base)
        for at, w in rng.sample(edits, rng.randrange(0, 4)) + [(rng.randrange(100), rng.choice(voc)) for _ in range(rng.randrange(0, 4))]:
            words[at] = w
        rows.append((i, " ".join(words[: rng.choice([100, 100, 85])])))
    rng.shuffle(rows)
    want = slow_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.linked(documents(spark, rows)).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 160


def test_rows_of_one_doc_id_are_one_document(spark):
    rows = mixed_texts()[:20]
    other = (rows[3][0], rows[17][1])
    chosen = spark.createDataFrame([(rows[3][1],), (other[1],)], "text string").orderBy(F.xxhash64("text")).first()["text"]
    want = slow_components([(i, chosen if i == other[0] else t) for i, t in rows])
    got = minhash.linked(documents(spark, [*rows, other])).collect()
    assert len(got) == 21 and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    names = rng.sample(range(1000), 90)
    edges = [(a, b) for part in (names[:50], names[50:70], names[70:]) for a, b in zip(part, part[1:], strict=False)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(part) for part in (names[:50], names[50:70], names[70:]) for n in part}


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.linked(documents(spark, EMPTY)).count() == 0


def test_densified_bins_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    for n in (3, 40, 600):
        common, rest = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
        hits = []
        for _ in range(60):
            salt = rng.integers(0, 1 << 63, dtype=np.uint64)
            a, b = (np.sort(minhash.mixed(x ^ salt)) for x in (common, np.concatenate([common, rest])))
            s = minhash.signatures(2, np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]))
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - n / (n + n // 3)) < 0.08


# --- 9 -------------------------------------------------------------------------


def test_ledger_matches_brute_force(spark):
    rows = mixed_texts() + [(970, "## a $b\nsame line\nsame line\n\n \nsame line"), (971, "a b c d e f g h a b c d e z z z z")]
    got = ledger.verdicts(documents(spark, rows)).collect()
    want = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[p : p + 5]) for p in range(len(w) - 4)]
        twice = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 4000 else set(grams)
        covered = {p + j for p, g in enumerate(grams) if g in twice for j in range(5)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert ledger.verdicts(documents(spark, EMPTY)).count() == 0


def test_ablations_count_by_mask(spark):
    book = ledger.ledger(documents(spark, mixed_texts()))
    rows = {r["rule"]: (r["n_failed"], r["n_alone"]) for r in ledger.ablations(book).collect()}
    masks = [r["failed"] for r in book.collect()]
    for i, rule in enumerate(ledger.RULES):
        if rule in rows:
            assert rows[rule] == (sum(m >> i & 1 for m in masks), sum(m == 1 << i for m in masks))


# --- 10 ------------------------------------------------------------------------


def test_segments_match_all_maximal_ones():
    def brute(positions, scores, drift):
        """Best segment by trying all pairs of hits."""
        best = 0.0
        for i in range(len(positions)):
            for j in range(i, len(positions)):
                gaps = positions[j] - positions[i] - (j - i)
                best = max(best, sum(scores[i : j + 1]) + drift * gaps)
        return best

    rng = random.Random(6)
    for _ in range(80):
        positions = sorted(rng.sample(range(200), rng.randrange(1, 12)))
        scores = [rng.uniform(0.5, 4) for _ in positions]
        found = toxicity.segments(np.array(positions), np.array(scores), -0.1)
        assert max(s for *_, s in found) == pytest.approx(brute(positions, scores, -0.1))
        assert all(b < c for (_, b, _), (c, _, _) in zip(found, found[1:]))


def test_toxicity_learns_and_scores_everything(spark):
    rng = random.Random(8)
    voc = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(voc) for _ in range(60)]
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            words[rng.randrange(60)] = rng.choice(["vile", "awful", "rotten"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), "x"))
    rows += [(1000, None), (1001, ""), (None, "vile awful"), (3, rows[3][1]), (1002, "vile " * 9000)]
    labels = spark.createDataFrame([*labels, (5, None, "x"), (None, 1, "x"), (8, 1, "x")], "doc_id long, toxic int, text string")
    docs = documents(spark, rows)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.9
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1002]["predicted"] == 1 and by_id[1000]["predicted"] == by_id[1001]["predicted"] == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    none = toxicity.toxicity(docs, labels.limit(0)).agg(F.max("predicted")).first()[0]
    assert none == 0 and toxicity.toxicity(documents(spark, EMPTY), labels).count() == 0


def test_every_word_has_log_odds(spark):
    rng = random.Random(12)
    voc = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        words = [rng.choice(voc) for _ in range(40)]
        words += ["harsh"] * (rng.random() < (0.6 if bad else 0.2)) + ["kindly"] * (rng.random() < (0.1 if bad else 0.6)) + ["vile"] * bad
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    model = toxicity.learned(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    kindly, harsh, vile, new = model.hits(pa.array(["kindly", "harsh", "vile", "zzz"]))
    assert kindly < -0.5 and 0.3 < harsh < 2.5 < vile and new == model.drift < 0
    (n, found), = toxicity.passages(model, pa.array(["vile " + "kindly " * 9 + "vile"]))
    assert n == 11 and len(found) == 2


def test_segments_are_found_in_linear_time():
    n = 60_000
    found = toxicity.segments(np.arange(0, 3 * n, 3), np.ones(n), -1.0)
    assert len(found) == n and all(s == 1 for *_, s in found)


# --- the pipeline ----------------------------------------------------------------


def test_pipeline_matches_its_stages_one_by_one(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    voc = [f"word{i}" for i in range(500)]
    item = " ".join(rng.choice(voc) for _ in range(30))
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice(voc) for _ in range(60)]
        if i % 4 == 0:
            for j in (5, 20, 30, 50):
                words[j] = ["vile", "awful", "rotten"][rng.randrange(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(500, rows[1][1]), (501, rows[2][1] + " end"), (502, "start " + item + " stop"), (503, "password = Abc123Def456 here"), (504, None), (505, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "sentencepiece"]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {500, 501, 502}.isdisjoint(got) and {1, 2, 3, 503, 504, 505} <= set(got)
    assert all(r["exact"] for r in got.values())
    assert sum(i % 4 == 0 for i in got if i < 160) <= 8 and sum(i % 4 != 0 for i in got if i < 160) >= 110
    text = pieces.codec(P.path("piece_bpe_32k.model")).decode(np.frombuffer(got[503]["ids"], "<u4"), np.array([got[503]["n_tokens"]]))[0].decode()
    assert text == "[SECRET] here" and got[504]["n_tokens"] == 0


def test_operators_leave_arrow_types_alone():
    assert pa.types.is_string(token_files.words_of(pa.array(["a b", None])).distinct.type)
