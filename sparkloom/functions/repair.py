"""Repair of damaged text: numerals, stray characters, wrong encodings. Rows that show no damage don't reach Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.quality import misencoded
from sparkloom.functions.text import count

#: Units and particles that follow a number.
UNITS = "번|월|일|년|시|분|초|개|명|회|차|호|층|점|위|%|원|달러|엔|위안|억|만|천|백|십|조|경|m|km|cm|mm|kg|g|mg|L|mL|㎡|㎢|ha|포|장|대|건|곳|권|편|종|세트|박스|케이스|팩"
#: Where the letter ㅇ stands for zeros, one after the other: between digits, before a unit, at a word's or line's end, behind a decimal point, at a number's start.
ZEROS = (r"(\d)(ㅇ+)(\d)", rf"(\d)(ㅇ+)({UNITS})", r"(\d)(ㅇ+)([\s\.\,\!\?\)\]\}]|$)", r"(\.\d*)(ㅇ+)(\d*)", r"(^|\s)(ㅇ+)(\d)")

#: Sequences and characters that come of a space read as half of a UTF-16 unit.
SEQUENCES = ("漠杳", "氠瑢", "漠瑢", "氠杳", "愠瑢", "攠瑢", "椠瑢", "渠瑢", "猠瑢", "琠瑢", "湰灧", "灧湰")
SINGLES = "杳瑢瑂潢獧整汯潰獩瑩湰灧灮杰"
SPACES = r"\x{2000}-\x{200D}\x{202F}\x{205F}\x{2074}\x{2075}"


def _space_units(firsts: str) -> str:
    """The characters whose UTF-16 unit is one of these and a space."""
    return "".join(chr(ord(c) << 8 | 0x20) for c in firsts)


_LETTERS = "".join(chr(c) for c in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)))
_OTHERS = "".join(chr(c) for c in range(0x40, 0x7B) if chr(c) not in _LETTERS)


def _zeros(texts: pd.Series) -> pd.Series:
    def one(t):
        n = 0
        for pattern in map(re.compile, ZEROS):
            for m in pattern.finditer(t):
                n += len(m[2])
            t = pattern.sub(lambda m: m[1] + "0" * len(m[2]) + m[3], t)
        return {"text": t, "repaired": n}

    return pd.DataFrame([one(t) if isinstance(t, str) else {"text": None, "repaired": 0} for t in texts], columns=["text", "repaired"])


def zeros_and_count(x: Column) -> Column:
    """struct<text, repaired>: the letter ㅇ as 0 in the five contexts of numbers, and how many there were."""
    found = F.pandas_udf(_zeros, "text string, repaired long")(F.when(F.contains(x, F.lit("ㅇ")), x))
    return F.when(F.contains(x, F.lit("ㅇ")), found).otherwise(F.struct(x.alias("text"), F.lit(0).cast("long").alias("repaired")))


def zeros(x: Column) -> Column:
    return zeros_and_count(x)["text"]


def zeros_repaired(x: Column) -> Column:
    return zeros_and_count(x)["repaired"]


def without_stray_han(x: Column, longest: int = 2, share: float = 0.05) -> Column:
    """No Han runs of up to ``longest`` characters, in texts where Han is rare."""
    han = r"[\x{4E00}-\x{9FFF}]"
    rare = count(x, han) <= share * F.char_length(x)
    return F.when(rare, F.regexp_replace(x, rf"(?<!{han}){han}{{1,{longest}}}(?!{han})", "")).otherwise(x)


def without_space_garbage(x: Column) -> Column:
    """struct<text, removed>: known sequences become a space, known characters go (spaces of other widths become one), and other units of
    a character and a space become one where Hangul is within five characters or they aren't common Han; then spaces and lines are tidied."""
    han, digits = _space_units(_LETTERS[10:]), _space_units(_LETTERS[:10])
    known = "|".join(SEQUENCES)
    near, unit = "[가-힣]", _space_units("".join(c for c in _OTHERS if ord(c) >= 0x4E))
    odd = _space_units("".join(c for c in _OTHERS if ord(c) < 0x4E))
    doubtful = rf"[{odd}]|(?<={near}(?s:.){{0,4}})[{unit}]|[{unit}](?=(?s:.){{0,4}}{near})"
    first = F.regexp_replace(x, known, " ")
    second = F.regexp_replace(F.regexp_replace(first, f"[{SPACES}]", " "), rf"[\x{{3000}}{han}{digits}{SINGLES}]", "")
    third = F.regexp_replace(second, doubtful, " ")
    removed = 2 * count(x, known) + count(first, rf"[{SPACES}\x{{3000}}{han}{digits}{SINGLES}]") + count(second, doubtful)
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(third, " {2,}", " "), "\n{3,}", "\n\n"), "(?md)^ +| +$", "")
    return F.struct(F.regexp_replace(tidy, r"^\s+|\s+$", "").alias("text"), removed.cast("long").alias("removed"))


def misread_utf16(x: Column, least: float = 0.5) -> Column:
    """Whether most characters are two ASCII bytes read as one UTF-16 unit."""
    pairs = r"[\x{2020}-\x{207E}\x{2120}-\x{217E}\x{2220}-\x{227E}\x{2320}-\x{7E7E}]"
    return count(x, pairs) > least * F.greatest(F.char_length(x), F.lit(1))


def _as_bytes(x: Column) -> Column:
    def one(t):
        raw = (t or "").encode("utf-16-le", "surrogatepass")
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return t

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return read(x)


def reread(x: Column) -> Column:
    """Misread texts as the bytes that they were; others stay."""
    return F.when(misread_utf16(x), _as_bytes(F.when(misread_utf16(x), x))).otherwise(x)


def _second_bytes(t: str) -> str | None:
    """Each second byte twice: what is left of a text whose bytes were doubled in another order."""
    raw = t.encode("utf-8", "surrogatepass")
    return None if len(raw) % 2 else bytes(b for b in raw[1::2] for _ in range(2)).decode("utf-8", "ignore")


def _units_apart(t: str) -> str:
    """Han characters of two ASCII bytes as these two, the low one first."""
    fits = lambda c: 0x4E00 <= c <= 0x9FFF and 0x20 <= c >> 8 < 0x7F and 0x20 <= c & 0xFF < 0x7F
    return "".join(chr(ord(c) & 0xFF) + chr(ord(c) >> 8) if fits(ord(c)) else c for c in t)


def _repaired(texts: pd.Series) -> pd.DataFrame:
    def one(t):
        found = _second_bytes(t)
        if found and sum(c < "\x80" and c.isprintable() for c in found) > 0.5 * len(found):
            return found, True
        found = _units_apart(t)
        if found != t and sum(c < "\x80" or "가" <= c <= "힣" for c in found) > 0.5 * len(found):
            return found, True
        return t, False

    return pd.DataFrame([one(t) if isinstance(t, str) else (None, False) for t in texts], columns=["text", "repaired"])


def utf16_repaired(x: Column) -> Column:
    """struct<text, repaired>: texts that are surely misencoded (``quality.misencoded``) as the first re-reading of theirs that looks like
    text: each second byte, else Han characters taken apart. Others stay."""
    bad = misencoded(x)
    found = F.pandas_udf(_repaired, "text string, repaired boolean")(F.when(bad, x))
    return F.when(bad, found).otherwise(F.struct(x.alias("text"), F.lit(False).alias("repaired")))
