"""URL filter: a weighted vocabulary matched by Aho-Corasick, under host and path rules."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paceline.llm.common import widened

#: Terms of which one is enough.
STRICT = (
    "porn", "xxx", "viagra", "cialis", "casino", "escort", "hentai", "malware", "phishing", "warez", "spam",
)

#: Terms of which several distinct ones are needed, with their weights.
SOFT = {
    "adult": 1.0, "ads": 1.0, "bet": 1.0, "bets": 1.0, "bonus": 1.0, "cheap": 1.0, "download": 0.5, "farm": 0.5,
    "free": 1.0, "gambling": 1.0, "jackpot": 1.0, "loan": 1.0, "nude": 1.0, "pills": 1.0, "poker": 1.0, "sex": 1.0,
    "slots": 1.0, "track": 1.0, "torrent": 1.0, "win": 1.0, "x": 1.0,
}

#: Weight of distinct soft terms, and their number, from which a URL is blocked.
ENOUGH, SEVERAL = 2.0, 2

#: Terms that a vocabulary read from a table may have; it is sent with every task.
MOST_TERMS = 200_000


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and the beginning of the path."""

    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("net", "/", True),
    Rule("example.net", "/en/", False),
    Rule("example.com", "/de/", True),
    Rule("org", "/fr/", False),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equally long ones the first by name."""
    name = verdict = F.when(F.lit(False), F.lit(""))
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = name.when(fits, F.lit(r.name))
        verdict = verdict.when(fits, F.lit("block" if r.block else "allow"))
    return name, verdict


class Vocabulary:
    """Counts distinct strict and soft terms that stand by themselves in a string."""

    def __init__(self, strict: tuple[str, ...], soft: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t in strict:
            self.automaton.add_word(t, (t, None))
        for t, weight in soft.items():
            if t not in strict:
                self.automaton.add_word(t, (t, weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, url: str) -> tuple[list[str], list[str], float]:
        """Strict terms, soft terms, and the soft terms' weight.

        A term counts where no ASCII letter or digit stands before or after it;
        a term found often counts once.
        """
        if not len(self.automaton):
            return [], [], 0.0
        low = url.translate(_FOLD)
        strict, soft = set(), {}
        for end, (term, weight) in self.automaton.iter(low):
            before = low[end - len(term) : end - len(term) + 1] if end >= len(term) else ""
            after = low[end + 1 : end + 2]
            if before in _INNER or after in _INNER:
                continue
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
        return sorted(strict), sorted(soft), sum(soft.values())


def read_vocabulary(terms: DataFrame, most: int = MOST_TERMS) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict terms and weighted soft terms of a table (term, weight); a null weight makes a term strict.

    A-Z are lower-cased, null and empty terms left out.  A term given several times
    is strict if one row says so, else has its largest weight.  The vocabulary goes
    to every task, so more than ``most`` terms, or a weight that is negative or no
    number, are refused.
    """
    term = F.translate(F.col("term").cast("string"), _UPPER, _LOWER)
    rows = (
        terms.select(term.alias("term"), F.col("weight").cast("double").alias("weight"))
        .filter("term <> ''")
        .groupBy("term")
        .agg(F.bool_or(F.col("weight").isNull()).alias("strict"), F.max("weight").alias("weight"))
        .limit(most + 1)
        .collect()
    )
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    soft = {r["term"]: r["weight"] for r in rows if not r["strict"]}
    wrong = sorted(t for t, w in soft.items() if not w >= 0 or w == float("inf"))
    if wrong:
        raise ValueError(f"terms whose weight is negative or no number: {wrong[:5]}")
    return tuple(sorted(r["term"] for r in rows if r["strict"])), soft


_FOLD = str.maketrans(_UPPER, _LOWER)
_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def term_hits(
    pages: DataFrame,
    strict: tuple[str, ...] = STRICT,
    soft: dict[str, float] | None = None,
    url: str = "url",
    decode: bool = False,
) -> DataFrame:
    """``pages`` plus strict_terms, soft_terms (arrays) and soft_weight; a null url has no terms.

    The vocabulary is sent with the tasks; it is a parameter and does not grow with the data.
    With ``decode``, terms are looked for in the URL as written and with its ``%XX`` read as
    UTF-8, and count where they stand in either.
    """
    soft = SOFT if soft is None else soft
    added = ("strict_terms", "soft_terms", "soft_weight")
    own = [c for c in pages.columns if c not in added]
    source = pages.select(*[pages[c] for c in own], F.col(url).cast("string").alias("__url"))

    def hits_of(find: Vocabulary, text: str) -> tuple[list[str], list[str], float]:
        hits = find(text)
        plain = unquote(text) if decode else text
        if plain == text:
            return hits
        more = find(plain)
        both = sorted({*hits[1], *more[1]})
        return sorted({*hits[0], *more[0]}), both, sum(soft[t] for t in both)

    def rows(batches):
        find = Vocabulary(strict, soft)
        for batch in batches:
            hits = [hits_of(find, u or "") for u in batch.column("__url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in own],
                    pa.array([h[0] for h in hits], pa.list_(pa.string())),
                    pa.array([h[1] for h in hits], pa.list_(pa.string())),
                    pa.array([h[2] for h in hits], pa.float64()),
                ],
                [*own, *added],
            )

    new = StructType.fromDDL("strict_terms array<string>, soft_terms array<string>, soft_weight double")
    schema = StructType([*pages.select(*own).schema.fields, *new.fields])
    return widened(pages.sparkSession, source).mapInArrow(rows, schema)


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: dict[str, float] | None = None,
    enough: float = ENOUGH,
    several: int = SEVERAL,
    decode: bool = False,
) -> DataFrame:
    """``pages`` (with url) plus host, path, rule, verdict and the terms found.

    A rule that fits decides.  Else one strict term blocks, or ``several`` distinct
    soft terms of weight ``enough`` together; a null url is allowed.  Rows are independent; columns of
    the added names are replaced.
    """
    host, path = split_url(F.col("url"))
    hits = term_hits(pages, strict, soft, decode=decode).withColumn("host", host).withColumn("path", path)
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    soft_found = (F.size("soft_terms") >= several) & (F.col("soft_weight") >= enough)
    found = (F.size("strict_terms") > 0) | soft_found
    return hits.withColumn("rule", rule).withColumn(
        "verdict", F.coalesce(ruled, F.when(found, F.lit("block")).otherwise(F.lit("allow")))
    )
