"""URL verdicts: host and path rules first, then two character language models.

Accepted and rejected URLs train one smoothed variable-order Markov model each (Witten-Bell
interpolation from the longest seen context down to a uniform distribution). A URL without a rule is
judged by the length-normalised difference of its log-likelihoods against a calibrated threshold.

All distinct labelled URLs take part: four fifths, by hash, are counted, the others set the threshold. The models
are tables of counts by context; URLs are scored by joins with them, every distinct URL once.

Defined results: a null URL counts as the empty text, has empty host and path and no rule; without
labelled URLs of both classes every URL without a rule is allowed; equal URLs get equal verdicts; rows are
never dropped, extra columns pass through, input columns of the result's names are replaced. Scores of characters are
added up in ten-billionths, so that their order does not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wordkin.functions.ordered import running_total
from wordkin.llm.common import ascii_lower, without
from wordkin.session import cut, small

ORDER = 5
ALPHABET = 256
START, STOP = "\x02", "\x03"
UNITS = 1e10
# Windows of URLs that a task gives out at once, and the width of score intervals that are counted apart.
BATCH = 1 << 16
WIDTH = 1e-4

# The rules of the query, verdict by host and path prefix.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or a parent domain of it) and a path, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, then in sorted(rules, key=lambda r: len(r[0])):
        domain, _, prefix = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(then)).otherwise(verdict)
    return name, verdict


class MarkovModel:
    """Character counts by context, for all context lengths up to the order: the model of a few texts."""

    def __init__(self, texts: list[str], order: int = ORDER, alphabet: int = ALPHABET):
        self.order, self.alphabet = order, alphabet
        self.counts: dict[str, dict[str, int]] = {}
        for text in texts:
            full = START * order + text + STOP
            for i in range(order, len(full)):
                for k in range(order + 1):
                    seen = self.counts.setdefault(full[i - k : i], {})
                    seen[full[i]] = seen.get(full[i], 0) + 1
        self.totals = {context: sum(seen.values()) for context, seen in self.counts.items()}

    def logp(self, context: str, char: str) -> float:
        p = 1.0 / self.alphabet
        for k in range(self.order + 1):
            shorter = context[len(context) - k :]
            seen = self.counts.get(shorter)
            if seen is None:
                break
            p = (seen.get(char, 0) + len(seen) * p) / (self.totals[shorter] + len(seen))
        return math.log(p)


def windows(urls: DataFrame) -> DataFrame:
    """urls(url, ...) -> (..., window, n): each character behind its context of ORDER, the end mark included."""
    names = [c for c in urls.columns if c != "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, counts = [], [], []

            def flush() -> pa.RecordBatch:
                index = pa.array(at, pa.int64())
                columns = [batch.column(batch.schema.get_field_index(n)).take(index) for n in names]
                return pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=[*names, "window", "n"])

            for row, url in enumerate(batch.column(batch.schema.get_field_index("url")).to_pylist()):
                full = START * ORDER + url + STOP
                for window, n in Counter(full[i - ORDER : i + 1] for i in range(ORDER, len(full))).items():
                    at.append(row)
                    found.append(window)
                    counts.append(n)
                    if len(at) >= BATCH:
                        yield flush()
                        at, found, counts = [], [], []
            yield flush()

    kept = urls.drop("url").schema
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept.fields]
    return urls.mapInArrow(run, ", ".join([*fields, "window string", "n long"]))


def contexts(rows: DataFrame) -> DataFrame:
    """rows(window, ...) with every context of the window's last character, the empty one first."""
    shorter = F.array(*(F.struct(F.substring("window", ORDER - k + 1, k).alias("context"), F.lit(k).alias("k")) for k in range(ORDER + 1)))
    return rows.withColumn("_c", F.explode(shorter)).select("*", "_c.*", F.substring("window", ORDER + 1, 1).alias("char")).drop("_c")


def train_url_model(labelled: DataFrame) -> DataFrame:
    """labelled(url, yes) -> counts(context, char, yes, no) by all contexts of all these URLs, both classes side by side."""
    seen = windows(labelled).groupBy("window").agg(*(F.sum(F.when(F.col("yes") == c, F.col("n")).otherwise(0)).alias(f"_{c}") for c in (True, False)))
    return cut(contexts(seen).groupBy("context", "char").agg(F.sum("_True").alias("yes"), F.sum("_False").alias("no")))


def window_scores(found: DataFrame, counts: DataFrame) -> DataFrame:
    """found(window) -> (window, delta): what the last character adds to the log-likelihood difference, in UNITS."""
    sides = ("yes", "no")
    totals = counts.groupBy("context").agg(
        *(F.sum(c).alias(f"all_{c}") for c in sides), *(F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in sides)
    )
    parts = [f"{p}{c}" for c in sides for p in ("", "all_", "kinds_")]
    # Every window has the empty context: its totals are one row and go to the windows.
    rows, empty = contexts(found), F.col("context") == ""
    rows = rows.where(empty).join(F.broadcast(totals.where(empty)), "context", "left").unionByName(rows.where(~empty).join(totals, "context", "left"))
    levels = rows.join(counts, ["context", "char"], "left").groupBy("window").agg(
        F.sort_array(F.collect_list(F.struct("k", *(F.coalesce(c, F.lit(0)).alias(c) for c in parts)))).alias("levels")
    )

    def logp(c: str) -> Column:
        def longer(p: Column, x: Column) -> Column:
            return F.when(x[f"all_{c}"] > 0, (x[c] + x[f"kinds_{c}"] * p) / (x[f"all_{c}"] + x[f"kinds_{c}"])).otherwise(p)

        return F.log(F.aggregate("levels", F.lit(1.0 / ALPHABET), longer))

    return levels.select("window", F.round((logp("yes") - logp("no")) * UNITS).cast("long").alias("delta"))


def score_urls(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """urls(id, url, ...) with score: the log-likelihood difference per character, the end mark included."""
    found = cut(windows(urls.select("id", "url")))
    deltas = cut(window_scores(found.select("window").distinct(), counts))
    sums = found.join(small(deltas), "window").groupBy("id").agg(F.sum(F.col("n") * F.col("delta")).alias("_sum"))
    return urls.join(sums, "id").withColumn("score", F.col("_sum") / UNITS / (F.length("url") + 1)).drop("_sum")


def calibrate(scored: DataFrame) -> float:
    """The cut between neighbouring scores of scored(score, yes) with the best mean of both classes' accuracy; of equal ones the lowest."""
    sums = scored.groupBy("score").agg(F.count_if("yes").alias("yes"), F.count_if(~F.col("yes")).alias("no"))
    below = running_total(running_total(cut(sums), [], "score", F.col("yes"), "lost", WIDTH), [], "score", F.col("no"), "blocked", WIDTH)
    all_ = scored.agg(F.count_if("yes").alias("yes"), F.count_if(~F.col("yes")).alias("no")).first()
    value = F.lit(1.0) - F.col("lost") / F.lit(all_.yes) + F.col("blocked") / F.lit(all_.no)
    best = below.select("score", value.alias("value")).orderBy(F.desc("value"), "score").first().score
    before = scored.where(F.col("score") < best).agg(F.max("score")).first()[0]
    return best - 0.5 if before is None else (best + before) / 2


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule, verdict and url_score (null where a rule decides) to every row."""
    base = without(pages, "host", "path", "rule", "_ruled", "verdict", "url_score").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"rule": name, "_ruled": verdict})
    text = F.coalesce(F.col(url), F.lit("")).alias("url")
    known = ruled.select(text, (F.col("_ruled") == "allow").alias("yes")).distinct()
    known = cut(known.withColumns({"id": F.monotonically_increasing_id(), "held": F.crc32(F.col("url").cast("binary")) % 5 == 0}))
    # A class whose labelled URLs are all held back, or none of them, takes part with all of them on both sides.
    n = {(r.yes, r.held): r["count"] for r in known.where("yes is not null").groupBy("yes", "held").count().collect()}

    def side(held: bool) -> DataFrame:
        whole = [c for c in (True, False) if not n.get((c, held))]
        return known.where(F.col("yes").isNotNull() & ((F.col("held") == held) | F.col("yes").isin(whole)))

    counts = train_url_model(side(False).select("url", "yes"))
    scored = cut(score_urls(known.where("yes is null").unionByName(side(True)), counts))
    ready = all(n.get((c, True)) or n.get((c, False)) for c in (True, False))
    allow = F.col("score") > calibrate(scored.where("yes is not null")) if ready else F.lit(True)
    judged = scored.where("yes is null").select(
        F.col("url").alias("_url"), F.when(allow, "allow").otherwise("block").alias("verdict"), F.col("score").alias("url_score")
    )
    open_ = ruled.where("_ruled is null").drop("_ruled")
    open_ = open_.join(judged, F.coalesce(open_[url], F.lit("")) == judged["_url"]).drop(judged["_url"])
    done = ruled.where("_ruled is not null").withColumns({"verdict": F.col("_ruled"), "url_score": F.lit(None).cast("double")}).drop("_ruled")
    return done.unionByName(open_)
