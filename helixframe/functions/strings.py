"""Column expressions for plain strings: cutting, searching, natural order, set notation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def before(s: Column, mark: str) -> Column:
    """Up to the first mark; null if it does not occur."""
    at = F.instr(s, mark)
    return F.when(at > 0, F.substr(s, F.lit(1), at - 1))


def after(s: Column, mark: str) -> Column:
    at = F.instr(s, mark)
    return F.when(at > 0, F.substr(s, at + len(mark)))


def safe_before(s: Column, mark: str) -> Column:
    """Up to the first mark; the whole string if it does not occur."""
    return F.substring_index(s, mark, 1)


def safe_after(s: Column, mark: str) -> Column:
    return F.coalesce(after(s, mark), s)


def before_last(s: Column, mark: str) -> Column:
    return F.when(F.instr(s, mark) > 0, F.substr(s, F.lit(1), F.length(s) - F.length(F.substring_index(s, mark, -1)) - len(mark)))


def after_last(s: Column, mark: str) -> Column:
    return F.when(F.instr(s, mark) > 0, F.substring_index(s, mark, -1))


def between(s: Column, left: str, right: str) -> Column:
    return before(after(s, left), right)


def overlapping_count(s: Column, word: str) -> Column:
    """Occurrences of a word, overlapping ones too."""
    return F.regexp_count(s, F.lit(f"(?={re.escape(word)})"))


def tokens(s: Column, separators: str = " \t\n") -> Column:
    """Parts between separators without empty ones."""
    return F.filter(F.split(s, f"[{re.escape(separators)}]"), lambda x: x != "")


def natural_key(s: Column, width: int = 12) -> Column:
    """A sort key in which numbers compare by value: every run of digits is padded to ``width``."""
    parts = F.regexp_extract_all(s, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)))


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def abbreviated(n: Column) -> Column:
    """1234 as 1.2K, and so on for M and G."""
    steps = [(1_000_000_000, "G"), (1_000_000, "M"), (1_000, "K")]
    out = n.cast("string")
    for size, letter in reversed(steps):
        out = F.when(n >= size, F.concat(F.format_string("%.1f", n.cast("double") / size), F.lit(letter))).otherwise(out)
    return out


def expanded_ranges(pattern: str) -> str:
    """``[#6-12]`` inside a pattern becomes an alternation of the numbers."""
    return re.sub(r"\[#(\d+)-(\d+)\]", lambda m: "(?:" + "|".join(str(i) for i in range(int(m[1]), int(m[2]) + 1)) + ")", pattern)


def parsed_int_set(text: str) -> list[tuple[int, int]]:
    """The set language ``n``, ``{a,b}``, ``[a,b]``, ``[a,b)``, joined by ``|``, as closed ranges.

    Ranges stay ranges, so a large set becomes a few comparisons, not a list."""
    out: list[tuple[int, int]] = []
    for part in text.replace(" ", "").split("|"):
        if m := re.fullmatch(r"-?\d+", part):
            out.append((int(m[0]), int(m[0])))
        elif m := re.fullmatch(r"\{(.*)\}", part):
            out += [(int(x), int(x)) for x in m[1].split(",") if x]
        elif m := re.fullmatch(r"\[(-?\d+),(-?\d+)([\])])", part):
            out.append((int(m[1]), int(m[2]) - (m[3] == ")")))
        else:
            raise ValueError(f"not a set: {part!r}")
    return out


def in_int_set(value: Column, text: str) -> Column:
    found = F.lit(False)
    for a, b in parsed_int_set(text):
        found = found | value.between(a, b)
    return found


# --- predicates, parsing, positions, edits ---


def is_int(s: Column) -> Column:
    return s.rlike(r"^[+-]?[0-9]{1,18}$")


def is_float(s: Column) -> Column:
    return s.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$")


def is_bool(s: Column) -> Column:
    return F.lower(s).isin("true", "false")


def parsed_int(s: Column) -> Column:
    return F.when(is_int(s), s).try_cast("long")


def parsed_float(s: Column) -> Column:
    return F.when(is_float(s), s).try_cast("double")


def parsed_bool(s: Column) -> Column:
    return F.when(is_bool(s), F.lower(s) == "true")


def position(s: Column, word: str, start: int = 1) -> Column:
    """First place (from 1) at or after ``start``, 0 if there is none."""
    return F.locate(word, s, start)


def position_last(s: Column, word: str) -> Column:
    """Last place (from 1), 0 if there is none."""
    n = F.locate(word[::-1], F.reverse(s))
    return F.when(n > 0, F.length(s) - n - len(word) + 2).otherwise(0)


def first_of(s: Column, letters: str) -> Column:
    """First place (from 1) of any of the letters, 0 if there is none."""
    return F.regexp_instr(s, F.lit(f"[{re.escape(letters)}]"))


def inserted(s: Column, at: int, text: str) -> Column:
    """``text`` before the character at ``at`` (from 0); at the end of shorter strings."""
    return F.concat(F.left(s, F.lit(at)), F.lit(text), F.substr(s, F.lit(at + 1)))


def erased(s: Column, at: int, n: int) -> Column:
    return F.concat(F.left(s, F.lit(at)), F.substr(s, F.lit(at + n + 1)))


def replaced_at(s: Column, at: int, n: int, text: str) -> Column:
    return F.concat(F.left(s, F.lit(at)), F.lit(text), F.substr(s, F.lit(at + n + 1)))


def replaced_first(s: Column, word: str, text: str) -> Column:
    at = F.instr(s, word)
    return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at - 1), F.lit(text), F.substr(s, at + len(word)))).otherwise(s)


def replaced_all(s: Column, word: str, text: str) -> Column:
    return F.replace(s, F.lit(word), F.lit(text))


def trimmed(s: Column, letters: str, side: str = "both") -> Column:
    cut = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side]
    return cut(s, F.lit(letters))


def with_extension(s: Column, extension: str) -> Column:
    """A file name with its last extension replaced; added where there is none."""
    return F.concat(F.regexp_replace(s, r"\.[^./]*$", ""), F.lit(extension))


def calculated(text: str, **names: Column) -> Column:
    """An integer expression of + - * / ^ and parentheses as a column; ``/`` drops the rest, ``^`` binds to the right."""
    tokens_ = re.findall(r"\s*(\d+|[A-Za-z_]\w*|[-+*/^()])", text)
    if "".join(tokens_) != re.sub(r"\s", "", text):
        raise ValueError(f"not an expression: {text!r}")
    rank = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 3}

    def operand() -> Column:
        token = tokens_.pop(0)
        if token == "(":
            inner = formula(1)
            tokens_.pop(0)
            return inner
        if token == "-":
            return -formula(2)
        return F.lit(int(token)).cast("long") if token.isdigit() else names[token].cast("long")

    def formula(least: int) -> Column:
        left = operand()
        while tokens_ and rank.get(tokens_[0], 0) >= least:
            sign = tokens_.pop(0)
            right = formula(rank[sign] + (sign != "^"))
            if sign == "/":
                left = F.call_function("div", left, right)
            elif sign == "^":
                left = F.pow(left, right).cast("long")
            else:
                left = left + right if sign == "+" else left - right if sign == "-" else left * right
        return left

    return formula(1)
