"""URL filters: rules first, then host word segmentation and naive Bayes.

A url is cut in SQL: the host lies after the first `://` up to `/`, `?`, `#` or the end, A-Z
lower-cased; the path follows up to `?`, `#` or the end. A rule fits its host and all
subdomains where the url's path starts with the rule's path; the longest rule wins.

Other urls are judged by the method. A unigram model of words, counted over the visible text
of all pages, splits each label of a host by the Viterbi algorithm into its likeliest words; a
multinomial naive Bayes model, counted over all urls that a rule decides, scores the words of
host and path. Numbers in either are one token. A url is blocked if block is the likelier class.

Both models count every word and token, and stay distributed tables: names and urls are joined to
the counts that they need, while totals and the smallest probability are taken over all.
Defined cases: a null url, or one without `://`, has an empty host and path and is judged by
the classes' shares; with no url decided by a rule, all others are allowed; repeated rows are
judged alike; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, table

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Counts that a task holds before it passes them on.
HELD = 500_000
LONGEST = 16
ALLOW, BLOCK = 0, 1
_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[a-z]{2,16}")
_PIECE = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def decided(rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the columns host and path, null where no rule fits."""
    rule = verdict = None
    for what, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


class Lexicon(NamedTuple):
    """How often every word of the pages' text occurs (w, n), with what probabilities need of all of them."""

    counts: DataFrame
    total: int
    least: int
    lengths: list[int]


def lexicon(pages: DataFrame) -> Lexicon:
    """All words of all pages' text."""

    def count(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for html in pdf.html:
                if html:
                    seen.update(_WORD.findall(_TAG.sub(" ", html).lower()))
            if len(seen) > HELD:
                yield pd.DataFrame(list(seen.items()), columns=["w", "n"])
                seen.clear()
        yield pd.DataFrame(list(seen.items()), columns=["w", "n"])

    counts = cut(pages.select("html").mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total, least, lengths = counts.agg(F.sum("n"), F.min("n"), F.collect_set(F.length("w"))).head()
    return Lexicon(counts, total or 1, least or 1, sorted(lengths))


class Segmenter:
    """Splits a concatenated name into its likeliest words; least is the smallest log probability, if words has not all of them."""

    def __init__(self, words: dict[str, float], least: float | None = None):
        self.words = words
        self.unknown = (min(words.values(), default=0.0) if least is None else least) - math.log(10.0)

    def split(self, name: str) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(name) + 1):
            found = (-math.inf, 0)
            for s in range(max(0, e - LONGEST), e):
                w = name[s:e]
                p = self.words.get(w)
                if p is None:  # an unknown word is ten times rarer with each letter
                    p = self.unknown - (e - s) * math.log(10.0)
                if best[s][0] + p > found[0]:
                    found = (best[s][0] + p, s)
            best.append(found)
        out, e = [], len(name)
        while e:
            out.append(name[best[e][1] : e])
            e = best[e][1]
        return tuple(reversed(out))


def pieces(host: str, path: str) -> list[str]:
    """What naive Bayes counts, in order: words of the host (h:) and of the path (p:); n: is a name still to be split."""
    out = []
    for label in host.split("."):
        out += ["h:#" if x.isdigit() else "n:" + x for x in _PIECE.findall(label)]
    return out + ["p:#" if x.isdigit() else "p:" + x for x in _PIECE.findall(path.lower())]


def rows(out: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], list(names))


def segments(hosts: DataFrame, words: Lexicon) -> DataFrame:
    """The words (i, w) of every distinct name n:... in the column host.

    Only substrings of the names meet the word counts, so no word is left out and none need be sent around."""

    def names(batches):
        for b in batches:
            yield rows([(t,) for t in {t for h in b.column(0).to_pylist() for t in pieces(h, "") if t[0] == "n"}], ("t",), (pa.string(),))

    lengths, total, least = words.lengths, words.total, math.log(words.least / words.total)

    def substrings(batches):
        out = []
        for b in batches:
            for own in b.column(0).to_pylist():
                name = own[2:]
                out += [(own, w) for w in {name[s : s + n] for n in lengths for s in range(len(name) - n + 1)}]
                if len(out) > 20_000:
                    yield rows(out, ("t", "w"), (pa.string(), pa.string()))
                    out = []
        yield rows(out, ("t", "w"), (pa.string(), pa.string()))

    def split(batches):
        for b in batches:
            out = []
            for t, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                log = {k["w"]: math.log(k["n"] / total) for k in known or ()}
                out += [(t, i, w) for i, w in enumerate(Segmenter(log, least).split(t[2:]))]
            yield rows(out, ("t", "i", "w"), (pa.string(), pa.int32(), pa.string()))

    own = cut(hosts.select("host").distinct().mapInArrow(names, "t string").distinct())
    parts_ = own.mapInArrow(substrings, "t string, w string")
    met = cut(words.counts.join(parts_.select("w").distinct(), "w", "left_semi"))
    known = parts_.join(maybe_broadcast(met), "w").groupBy("t").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    return cut(own.join(known, "t", "left").mapInArrow(split, "t string, i int, w string"))


class Model(NamedTuple):
    """Naive Bayes: counts of every token among allowed and blocked urls (t, a, b), and what is summed over all of them."""

    tokens: DataFrame
    prior: float
    n: int
    na: int
    nb: int


def train(pages: DataFrame, words: Lexicon, rules=RULES) -> Model:
    """Naive Bayes from all urls that a rule decides, with add-one smoothing."""
    host, path = parts()
    known = pages.select(host.alias("host"), path.alias("path"))
    known = cut(known.withColumn("v", decided(rules)[1]).where("v is not null").groupBy("host", "path", "v").agg(F.count("*").alias("n")))

    def count(batches):
        seen = (Counter(), Counter())

        def sums_so_far():
            return pd.DataFrame([(t, seen[ALLOW][t], seen[BLOCK][t]) for t in set(seen[0]) | set(seen[1])], columns=["t", "a", "b"])

        for pdf in batches:
            for h, p, v, n in zip(pdf.host, pdf.path, pdf.v, pdf.n, strict=True):
                own = seen[v == "block"]
                for t in pieces(h, p):
                    own[t] += n
            if len(seen[0]) + len(seen[1]) > HELD:
                yield sums_so_far()
                seen[0].clear(), seen[1].clear()
        yield sums_so_far()

    sums = [F.sum(c).alias(c) for c in ("a", "b")]
    met = cut(known.mapInPandas(count, "t string, a long, b long").groupBy("t").agg(*sums))
    # Names are summed before they are split, so each meets its words once.
    named = met.join(segments(known, words), "t").select(F.concat(F.lit("h:"), "w").alias("t"), "a", "b")
    tokens = cut(met.where(~F.col("t").startswith("n:")).unionAll(named).groupBy("t").agg(*sums))
    n, na, nb = tokens.agg(F.count("*"), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).head()
    urls = {r.v: r.n for r in known.groupBy("v").agg(F.sum("n").alias("n")).collect()}
    prior = math.log((urls.get("block", 0) + 1) / (urls.get("allow", 0) + 1)) if urls else -1.0
    return Model(tokens, prior, n + 1, na, nb)


def judge(pages: DataFrame, words: Lexicon, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    host, path = parts()
    all_rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = decided(rules)
    all_rows = all_rows.withColumns({"rule": rule, "verdict": verdict})
    left = cut(all_rows.where("verdict is null").withColumn("id", F.monotonically_increasing_id()))

    def names(batches):
        for b in batches:
            out = [(i, at, t) for i, h, p in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) for at, t in enumerate(pieces(h, p))]
            yield rows(out, ("id", "at", "t"), (pa.int64(), pa.int32(), pa.string()))

    prior, n, na, nb = model[1:]

    def odds(a: int, b: int) -> float:
        return math.log((b + 1) / (nb + n)) - math.log((a + 1) / (na + n))

    def run(batches):
        for b in batches:
            out = [
                "block" if prior + sum(odds(*r) for _, r in sorted(((x["at"], x["i"]), (x["a"], x["b"])) for x in found or ())) > 0 else "allow"
                for found in b.column("found").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(out, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    split = segments(left, words).select(F.col("t").alias("name"), "i", F.concat(F.lit("h:"), "w").alias("t"))
    split = split.join(maybe_broadcast(model.tokens), "t").select(F.col("name").alias("t"), "i", "a", "b")
    whole = model.tokens.where((F.col("t") == "h:#") | F.col("t").startswith("p:")).select("t", F.lit(0).alias("i"), "a", "b")
    counts = cut(split.unionAll(whole))
    # Tokens that no decided url has say nothing.
    found = left.select("id", "host", "path").mapInArrow(names, "id long, at int, t string").join(maybe_broadcast(counts), "t")
    found = found.groupBy("id").agg(F.collect_list(F.struct("at", "i", "a", "b")).alias("found"))
    judged = left.join(found, "id", "left").select("page_id", "host", "path", "rule", "found")
    return all_rows.where("verdict is not null").unionAll(judged.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    words = lexicon(pages)
    return judge(pages, words, train(pages, words))
