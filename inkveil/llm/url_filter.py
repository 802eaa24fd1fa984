"""URL filters: rules first, then a ratio of two character language models.

Rules are `host/path` prefixes; the longest that fits decides. Other URLs are judged by two variable-order Markov
models over bytes, one of accepted and one of rejected URLs: each order's counts are smoothed with the next lower
order (Witten-Bell), down to a uniform law. The difference of the log-likelihoods, divided by the URL's length,
is calibrated by a logistic curve on labelled URLs that the models have not seen, both classes weighing the same;
URLs that come out at 0.5 or more are allowed.

The models are fitted on a bounded sample of labelled rows: at most `sample` distinct URLs of each class, chosen
by hash over the whole table; a fifth of them calibrates. Their contexts' counts, bounded by that sample, are what
is sent to the executors. All URLs are scored, whole, in batches.

Defined results: a null URL or one without `://` has empty host and path, no rule, and is scored as the text that it
is (null: empty). Where a class has no labelled URL, the models say nothing and URLs without a rule are allowed.
Repeated rows get the same verdict each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch, lower_ascii

#: Fixed values: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 5
SAMPLE = 5000
PAD, END = 256, 257
SYMBOLS = 257  # the bytes and the end
SLICE = 2000


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(host), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, the first of equally long ones; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, slash, tail = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _stream(urls: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All URLs in one array of symbols, each led by `order` pads and closed by the end; the places of the symbols to
    predict and the URL of each."""
    data = [u.encode("utf-8", "surrogatepass") for u in urls]
    sizes = np.array([len(d) + order + 1 for d in data], dtype=np.int64)
    out = np.full(int(sizes.sum()), PAD, dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    owner = np.repeat(np.arange(len(data)), sizes - order)
    places = np.arange(len(owner)) + (owner + 1) * order
    out[places] = END
    inner = np.ones(len(owner), dtype=bool)
    inner[starts + sizes - 1 - (np.arange(len(data)) + 1) * order] = False
    out[places[inner]] = flat
    return out, places, owner


def _hashes(stream: np.ndarray, places: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 0, the hashes of the contexts and of contexts with the symbol that follows."""
    context = np.full(len(places), 0x243F6A8885A308D3, dtype=np.uint64)
    symbol = (stream[places] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(order + 1):
        if k:
            context = (context ^ (stream[places - k] + np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
            context ^= context >> np.uint64(31)
        pair = (context ^ symbol) * np.uint64(0x165667B19E3779F9)
        yield context, pair ^ (pair >> np.uint64(29))


class CharModel:
    """A variable-order Markov model: per order, sorted hashes with counts."""

    def __init__(self, urls: list[str], order: int = ORDER):
        self.order, self.levels = order, []
        stream, places, _ = _stream(urls, order)
        for context, pair in _hashes(stream, places, order):
            pairs, first, uses = np.unique(pair, return_index=True, return_counts=True)
            contexts, total = np.unique(context, return_counts=True)
            held, kinds = np.unique(context[first], return_counts=True)
            assert len(held) == len(contexts)
            self.levels.append((pairs, uses.astype(np.float32), contexts, total.astype(np.float32), kinds.astype(np.float32)))

    def log_likelihoods(self, urls: list[str]) -> np.ndarray:
        """Natural log-probability of each URL with its end."""
        stream, places, owner = _stream(urls, self.order)
        p = np.full(len(places), 1.0 / SYMBOLS)
        for (context, pair), (pairs, uses, contexts, total, kinds) in zip(
            _hashes(stream, places, self.order), self.levels, strict=True
        ):
            n, at = _find(contexts, context)
            m, there = _find(pairs, pair)
            c = np.where(m, uses[there], 0.0)
            sure = (c + kinds[at] * p) / (total[at] + kinds[at])
            p = np.where(n, sure, p)
        return np.bincount(owner, weights=np.log(p), minlength=len(urls))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


class UrlJudge:
    """Both models and the calibration a * difference + b."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER):
        self.ready = len(accepted) > 1 and len(rejected) > 1
        if not self.ready:
            return
        cut_a, cut_r = max(1, len(accepted) * 4 // 5), max(1, len(rejected) * 4 // 5)
        self.good, self.bad = CharModel(accepted[:cut_a], order), CharModel(rejected[:cut_r], order)
        x = self.difference(accepted[cut_a:] + rejected[cut_r:])
        n, m = len(accepted) - cut_a, len(rejected) - cut_r
        y, w = np.r_[np.ones(n), np.zeros(m)], np.r_[np.full(n, 0.5 / n), np.full(m, 0.5 / m)]
        self.a, self.b = _logistic(x, y, w)

    def difference(self, urls: list[str]) -> np.ndarray:
        size = np.array([len(u.encode("utf-8", "surrogatepass")) + 1 for u in urls])
        return (self.good.log_likelihoods(urls) - self.bad.log_likelihoods(urls)) / size

    def probability(self, urls: list[str]) -> np.ndarray:
        if not self.ready or not urls:
            return np.full(len(urls), np.nan)
        return 1 / (1 + np.exp(-np.clip(self.a * self.difference(urls) + self.b, -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, decay: float = 1e-4) -> tuple[float, float]:
    """Weighted logistic regression of y on x by Newton's method, its slope kept from growing without end."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + decay * a, (w * (p - y)).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + decay, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-6)), float(b)


def labelled_sample(judged: DataFrame, sample: int) -> dict[str, list[str]]:
    """Up to `sample` different URLs of each verdict, those of the smallest hashes. Repeats are dropped first, so
    how often a URL occurs does not matter; each partition passes on its `sample` smallest."""
    seen = judged.where("verdict is not null and url is not null").select("verdict", "url")
    order = F.pmod(F.xxhash64(F.xxhash64("url")), F.lit(1 << 62))
    out: dict[str, list[str]] = {}
    for verdict in ("allow", "block"):
        rows = seen.where(F.col("verdict") == verdict).select("url").distinct()
        out[verdict] = [r[0] for r in rows.orderBy(order, "url").limit(sample).collect()]
    return out


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `df`: id, host, path, rule, verdict, probability (of acceptance, for URLs without a rule)."""
    host, path = parts(F.col("url"))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    seeds = labelled_sample(judged, sample)
    judge = df.sparkSession.sparkContext.broadcast(UrlJudge(seeds["allow"], seeds["block"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                open_ = np.array([v is None for v in part.column("verdict").to_pylist()])
                urls = [u or "" for u, o in zip(part.column("url").to_pylist(), open_, strict=True) if o]
                p = np.full(part.num_rows, np.nan)
                p[open_] = judge.value.probability(urls)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in ("id", "host", "path", "rule", "verdict")], pa.array(p, from_pandas=True)],
                    names=["id", "host", "path", "rule", "verdict", "probability"],
                )

    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, host string, path string, rule string, verdict string, probability double"
    out = Scratch(df.sparkSession).table(judged.mapInArrow(run, schema))
    judge.destroy()
    said = F.coalesce("verdict", F.when(F.coalesce("probability", F.lit(1.0)) >= 0.5, "allow").otherwise("block"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", said.alias("verdict"), "probability")
