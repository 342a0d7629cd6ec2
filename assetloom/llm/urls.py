"""URL filters: rules by host and path, and naive Bayes over segmented host and path words.

Names in a host are often words written together. A unigram model, counted over the text of all
pages, splits each run of letters into its likeliest words (Viterbi). Multinomial naive Bayes then
weighs the words of host and path. It learns from all pages, labelled by a list of seed words: a
page with one strong or two weak seed words in host or path, the last label of the host included,
is to be blocked. Both counts hold every word and stay in Spark: substrings of the distinct hosts,
and the words of the distinct kinds of pages, are joined with them. Pages are of one kind if their
hosts are the same and their paths have the same words.

A label of a host has at most 63 characters, so no longer words are looked for in one.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule, and
is allowed. Repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import table
from assetloom.llm.tables import small_side
from assetloom.sources.scratch import stored

#: (verdict, rule); a rule is a host and a path from its first slash on.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Seed words, by which pages are labelled for the fit: one strong word says enough.
STRONG = frozenset(
    """adult adults bet bets betting blackjack casino casinos cialis erotic escort escorts fetish gamble gambling hentai jackpot lottery malware milf
    nsfw nude nudes pharma phish phishing pills poker porn porno pornos replica roulette scam scams sex sexy slots spam spammer spyware viagra warez xxx""".split()
)
WEAK = frozenset("ad ads adserver banner bonus buy cheap click deals discount download free loan loans money offer popup prize promo track tracker tracking win winner".split())
#: No label of a host is longer.
LONGEST_WORD = 63
#: Of all words counted, the share that each seed word has besides, so that it can be split off.
SEED_SHARE = 5e-5
#: Rows of substrings that leave a task at once.
ROWS = 20_000
PIECE = re.compile(r"[a-z]+|[0-9]+")


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """The table with columns host and path, which take the place of columns of these names."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.col(url_col).substr(at + 3, F.length(url_col))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))})


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Unigrams:
    """Log probabilities of words, and of an unknown word by its length."""

    logs: dict[str, float]
    total: float

    def __post_init__(self):
        self.known: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        """The likeliest words of a run of letters; the fewest of equally likely ones."""
        if name in self.known:
            return self.known[name]
        best: list[tuple[float, int]] = [(0.0, 0)]  # of each end: log probability, start of the last word
        for end in range(1, len(name) + 1):
            best.append(max((best[start][0] + self._log(name[start:end]), -start) for start in range(max(0, end - LONGEST_WORD), end)))
        out, end = [], len(name)
        while end:
            start = -best[end][1]
            out.append(name[start:end])
            end = start
        self.known[name] = out = out[::-1]
        return out

    def _log(self, word: str) -> float:
        return self.logs.get(word, -math.log(self.total) - len(word) * math.log(10))


def count_unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(w, n): how often each word stands in the text of all pages."""
    text = F.lower(F.regexp_replace(F.col(html_col), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, r"[^a-z]+")).alias("w")).filter(F.length("w") > 1)
    return stored(words.groupBy("w").agg(F.count("*").alias("n")))


def own_part(host: str) -> tuple[str, str]:
    """A host without its last label, and that label; a host of one label has no last one besides."""
    head, dot, last = host.rpartition(".")
    return (head, last) if dot else (last, "")


def host_words(host: str, unigrams: Unigrams) -> list[str]:
    """The words of a host, of its last label only seed words; runs of digits are ``0``."""
    own, last = own_part(host)
    words = [w for p in PIECE.findall(own) for w in (unigrams.split(p) if p[0] > "9" else ["0"])]
    return words + [p for p in PIECE.findall(last) if p in STRONG | WEAK]


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, host) to (id, w): what may be a word in a host, once each."""
    for batch in batches:
        ids, words = [], []
        for i, host in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = [p for p in PIECE.findall(own_part(host)[0]) if p[0] > "9"]
            for w in {r[a:b] for r in runs for a in range(len(r)) for b in range(a + 2, min(a + LONGEST_WORD, len(r)) + 1)}:
                ids.append(i)
                words.append(w)
                if len(ids) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], names=["id", "w"])
                    ids, words = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], names=["id", "w"])


def split_hosts(hosts: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(host, words) of each host, once; ``unigrams``: w, n."""
    total = float(unigrams.agg(F.sum("n")).first()[0] or 1)
    seeds = {w: total * SEED_SHARE for w in STRONG | WEAK}
    total += sum(seeds.values())

    def run(hosts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for host, known in zip(hosts.to_pylist(), found.to_pylist(), strict=True):
            counts = dict(seeds)
            for k in known or []:
                counts[k["w"]] = counts.get(k["w"], 0.0) + k["n"]
            out.append(host_words(host, Unigrams({w: math.log(n / total) for w, n in counts.items()}, total)))
        return pa.array(out, type=pa.list_(pa.string()))

    run.__annotations__ = {"hosts": pa.Array, "found": pa.Array, "return": pa.Array}
    ids = stored(hosts.select("host").distinct().withColumn("id", F.monotonically_increasing_id()))
    parts = ids.select("id", "host").mapInArrow(_substrings, "id long, w string")
    found = parts.join(unigrams, "w").groupBy("id").agg(F.collect_list(F.struct("w", "n")).alias("found"))
    return stored(ids.join(found, "id", "left").select("host", F.arrow_udf(run, returnType=T.ArrayType(T.StringType()))("host", "found").alias("words")))


def path_words(path: Column) -> Column:
    """The words of a path, each after a slash; runs of digits are ``/0``."""
    return F.transform(F.regexp_extract_all(F.lower(path), F.lit("([a-z]+|[0-9]+)"), F.lit(1)), lambda w: F.when(w >= "a", F.concat(F.lit("/"), w)).otherwise("/0"))


def seed_label(host: Column, path: Column) -> Column:
    """Whether a page is to be blocked by the seed words among those of its host and path."""
    words = F.array_union(host, F.transform(path, lambda w: F.substr(w, F.lit(2))))
    strong, weak = (F.array(*map(F.lit, sorted(x))) for x in (STRONG, WEAK))
    return F.arrays_overlap(words, strong) | (F.size(F.array_intersect(words, weak)) > 1)


def page_kinds(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """(kind, host, path_words, n, words, label): the kinds of pages, how many there are, all words
    of host and path, and the seeds' label. ``urls``: host, path_words; ``hosts``: host, words."""
    kinds = stored(urls.groupBy("host", "path_words").agg(F.count("*").alias("n")))
    known = kinds.join(small_side(hosts), "host").withColumn("label", seed_label(F.col("words"), F.col("path_words")))
    return stored(known.withColumn("kind", F.monotonically_increasing_id()).select("kind", "host", "path_words", "n", F.col("words").alias("host_words"), F.concat("words", "path_words").alias("words"), "label"))


def fit_bayes(kinds: DataFrame) -> DataFrame:
    """(w, weight): log odds of blocking of every word, learned from all pages. Add-one smoothing;
    both classes are equally likely beforehand, so that a rare one is found as well."""
    n = lambda label: F.sum(F.when(label, F.col("n")).otherwise(0))
    counts = stored(kinds.select("label", "n", F.explode("words").alias("w")).groupBy("w").agg(n(F.col("label")).alias("block"), n(~F.col("label")).alias("allow")))
    sums = counts.agg(*[(F.coalesce(F.sum(c), F.lit(0)) + F.count("*") + 1).alias(c) for c in ("block", "allow")]).first()
    part = lambda c: F.log((F.col(c) + 1) / F.lit(float(sums[c])))
    return stored(counts.select("w", (part("block") - part("allow")).alias("weight")))


def score_kinds(kinds: DataFrame, weights: DataFrame) -> DataFrame:
    """(host, path_words, host_words, odds): the log odds of blocking of each kind of page."""
    each = kinds.select("kind", F.posexplode("words").alias("at", "w")).join(small_side(weights), "w")
    # summed in the order of the words, so that runs agree to the last bit
    ordered = F.array_sort(F.collect_list(F.struct("at", "weight")))
    odds = each.groupBy("kind").agg(F.aggregate(ordered, F.lit(0.0), lambda sum_, x: sum_ + x["weight"]).alias("odds"))
    return stored(kinds.join(odds, "kind", "left").select("host", "path_words", "host_words", F.coalesce("odds", F.lit(0.0)).alias("odds")))


def op3_url_filters(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages")
    urls = split_url(pages.select("page_id", "url")).withColumn("path_words", path_words(F.col("path")))
    hosts = split_hosts(urls, count_unigrams(pages))
    kinds = page_kinds(urls, hosts)
    scored = score_kinds(kinds, fit_bayes(kinds))
    judged = urls.join(small_side(scored), ["host", "path_words"]).withColumn("r", longest_rule(F.col("host"), F.col("path"), RULES))
    own = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), F.array_join("host_words", " ").alias("host_words"), F.col("odds").alias("block_odds"))
