"""Keyword classification by a dictionary given as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import keywords

Words = dict[str, list[str]]

#: The dictionary that documents of environmental authorities are classified by.
TYPES: Words = {
    "notice": ["공고", "고시", "입찰", "모집", "알림", "안내", "공지"],
    "press_release": ["보도자료", "언론보도", "브리핑", "보도", "해명자료"],
    "legislation": ["법률", "법령", "규정", "규칙", "조례", "훈령", "예규", "고시안", "시행령", "시행규칙"],
    "meeting": ["회의록", "의사록", "회의", "심의", "자문회의", "위원회"],
    "report": ["보고서", "연구", "결과보고", "실적", "통계", "현황", "분석"],
    "guideline": ["가이드라인", "지침", "매뉴얼", "안내서", "해설서", "표준"],
}
SECTORS: Words = {
    "air": ["대기", "미세먼지", "배출가스", "대기오염", "대기질", "온실가스", "배출권", "탄소", "질소산화물", "황산화물"],
    "water": ["수질", "폐수", "하수", "수처리", "방류", "상수", "지하수", "해양", "수자원"],
    "waste": ["폐기물", "폐기", "재활용", "순환자원", "자원순환", "생산자책임", "EPR"],
    "climate": ["기후", "기후변화", "탄소중립", "넷제로", "온실가스", "RE100", "ESG", "녹색"],
    "energy": ["에너지", "신재생", "태양광", "풍력", "전력", "연료전지", "수소"],
    "chemical": ["화학물질", "유해화학", "REACH", "물질안전", "MSDS", "화관법", "화평법"],
}
DEPTHS: Words = {
    "headquarters": ["환경부", "산업통상자원부", "국무조정실", "기획재정부", "국토교통부", "해양수산부"],
    "agency": ["한국환경공단", "한국에너지공단", "환경산업기술원", "국립환경과학원", "연구원", "진흥원", "공단"],
    "local": ["시청", "군청", "구청", "도청", "광역시", "특별시", "지방", "지자체"],
}
PHASES: Words = {
    "proposal": ["예고", "의견수렴", "예고안", "입법예고", "행정예고"],
    "enacted": ["제정", "공포", "개정", "시행령"],
    "enforced": ["시행", "적용", "발효"],
    "audit": ["점검", "감사", "단속", "지도", "위반"],
}


@dataclass(frozen=True)
class Dictionary:
    """What documents are classified by: words of each type, sector, depth (of the organisation) and phase, and what holds without any."""

    types: Words = field(default_factory=lambda: TYPES)
    sectors: Words = field(default_factory=lambda: SECTORS)
    depths: Words = field(default_factory=lambda: DEPTHS)
    phases: Words = field(default_factory=lambda: PHASES)
    no_type: str = "other"
    no_sector: str = "general"
    no_depth: str = "headquarters"


def classified(docs: DataFrame, text: str, org: str, board: str, by: Dictionary | None = None, out: str = "classified", most: int = 10) -> DataFrame:
    """``docs`` with struct<type, sectors, depth, phase, confidence, keywords>.

    Organisation, board and text are searched as one string, case and all; depth looks at the organisation alone. type: the most words found,
    the earlier of a tie; sectors: all with a word; depth, phase: the first with a word; confidence: (words of the type + sectors) / 5, at most
    1; keywords: the first ``most`` words of types and sectors, in the dictionary's order. Nulls are empty. One automaton runs over each text.
    """
    by = by or Dictionary()
    words = list(dict.fromkeys(w for group in (by.types, by.sectors, by.depths, by.phases) for ws in group.values() for w in ws))
    place = {w: i for i, w in enumerate(words)}
    find = keywords.matcher(docs.sparkSession, words)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.withColumns({"__in": find(F.concat_ws(" ", part(org), part(board), part(text))), "__org": find(part(org))})
    has = lambda of, w: F.array_contains(of, F.lit(place[w]))
    number = lambda ws: sum((has("__in", w).cast("int") for w in ws), F.lit(0))
    any_of = lambda of, ws: F.arrays_overlap(F.col(of), F.array(*[F.lit(place[w]) for w in ws]))
    counts = F.array(*[F.struct(number(ws).alias("n"), F.lit(-i).alias("order"), F.lit(t).alias("type")) for i, (t, ws) in enumerate(by.types.items())])
    rows = rows.withColumn("__top", F.array_max(counts)).withColumn("__sectors", F.array_compact(F.array(*[F.when(any_of("__in", ws), s) for s, ws in by.sectors.items()])))
    sectors = F.when(F.size("__sectors") > 0, F.col("__sectors")).otherwise(F.array(F.lit(by.no_sector)))
    depth = F.coalesce(*[F.when(any_of("__org", ws), d) for d, ws in by.depths.items()], F.lit(by.no_depth))
    phase = F.coalesce(*[F.when(any_of("__in", ws), p) for p, ws in by.phases.items()], F.lit(None).cast("string"))
    told = list(dict.fromkeys(w for group in (by.types, by.sectors) for ws in group.values() for w in ws))
    found = F.slice(F.array_compact(F.array(*[F.when(has("__in", w), w) for w in told])), 1, most)
    rows = rows.withColumn("__of", sectors)
    result = F.struct(
        F.when(F.col("__top.n") > 0, F.col("__top.type")).otherwise(by.no_type).alias("type"), F.col("__of").alias("sectors"), depth.alias("depth"), phase.alias("phase"),
        F.least(F.lit(1.0), (F.col("__top.n") + F.size("__of")) / 5).alias("confidence"), found.alias("keywords"),
    )
    return rows.withColumn(out, result).drop("__in", "__org", "__top", "__sectors", "__of")


def hits(x: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(x), w))


def classify(x: Column, types: dict[str, list[str]], tags: dict[str, list[str]], depths: dict[str, list[str]]) -> Column:
    """struct<type, tags, depth, confidence, matched>.

    type: the most keyword hits, the earlier of a tie, ``other`` without any; tags: all with a hit; depth: the first with a hit;
    confidence: (hits of the type + tags) / 5, 1 at most; matched: the first ten keywords found, in the dictionary's order.
    """
    counts = F.array(*[F.struct(F.size(hits(x, w)).alias("n"), F.lit(-i).alias("order"), F.lit(t).alias("type")) for i, (t, w) in enumerate(types.items())])
    top = F.array_max(counts)
    found_tags = F.array_compact(F.array(*[F.when(F.size(hits(x, w)) > 0, t) for t, w in tags.items()]))
    depth = F.coalesce(*[F.when(F.size(hits(x, w)) > 0, t) for t, w in depths.items()])
    every = [w for group in (types, tags, depths) for words in group.values() for w in words]
    return F.struct(
        F.when(top["n"] > 0, top["type"]).otherwise("other").alias("type"), found_tags.alias("tags"), depth.alias("depth"),
        F.least(F.lit(1.0), (top["n"] + F.size(found_tags)) / 5).alias("confidence"), F.slice(F.array_distinct(hits(x, every)), 1, 10).alias("matched"),
    )


def first_rule(headers: Column, rules: list[tuple[str, list[str], list[str]]], default: str = "unknown") -> Column:
    """The first rule, (name, words that all must be in some header, words of which one must), that the headers meet."""
    seen = lambda w: F.exists(headers, lambda h: F.contains(h, F.lit(w)))
    out = F.lit(default)
    for name, every, some in reversed(rules):
        met = F.lit(True)
        for w in every:
            met &= seen(w)
        if some:
            one = F.lit(False)
            for w in some:
                one |= seen(w)
            met &= one
        out = F.when(met, name).otherwise(out)
    return out
