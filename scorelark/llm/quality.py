"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's own evidence is a logistic model over hashed words and the shape
of the text, for each label: poor quality and toxic. It is fitted on at most
``SAMPLE`` labelled rows, those with the smallest hash of their id; every
document is scored.

The sites then speak for their documents: the mean evidence of a path (here a
language of a host) is shrunk toward that of its host, and the host's toward
that of all documents, by beta priors. A prior's strength comes from how much
the sites differ beyond chance (method of moments), so sparse sites keep the
prior and large ones their own rate. A document's posterior is its evidence
with the odds of its path in place of the overall odds, within ``SWAY``; its
own evidence is taken out of its path's and host's first, so that a site of one
document tells nothing about it. A document is rejected if a posterior reaches
``REJECT``.

Sums by site are aggregated before they are shuffled, so a host with a third
of all rows costs no more than another. A null text counts as an empty one; a
null host or path is a site of its own; labels that are null, or whose document
is missing, are left out; of several labels of a document the largest counts;
without any labelled rows of both kinds a model gives every document the same
evidence, far from rejection. Repeated rows each get their decision. Empty and
very long texts are scored like others, whole. An empty table of documents gives
no rows. Extra columns stay as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelark.llm.common import kept, release, vacate

#: Labelled rows that the models are fitted on at most.
SAMPLE = 20_000
WORD_BITS, CHOSEN = 18, 4096
ROUNDS, RATE, DECAY = 300, 0.3, 1e-3
REJECT, SWAY = 0.5, 1.5
#: Rows that a round of the fit takes at once; sites that may be sent to all tasks; parts of a hot site, and the share of all rows that makes one hot.
PORTION, SITES_SENT, SALTS, HOT = 2048, 100_000, 1024, 1000
#: label column, value that speaks against the document.
TARGETS = (("poor", "quality", 0), ("toxic", "toxic", 1))
SHAPE = 10
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
MARKS = bytes(c for c in range(256) if not (c < 33 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or c in b".,"))
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LINE = re.compile(rb"[^\n]+")


def _share(data: bytes, of: bytes) -> float:
    return (len(data) - len(data.translate(None, of))) / max(1, len(data))


def features(data: bytes) -> tuple[np.ndarray, list[float]]:
    """Hashes of the distinct words, and the shape of the text: numbers from 0 to about 1."""
    words = data.translate(FOLD).split()
    distinct = set(words)
    n = max(1, len(words))
    lines = LINE.findall(data)
    last = max((sum(a == b for a, b in zip(words, words[1:], strict=False)), 0))
    shape = [
        _share(data, MARKS), _share(data, UPPER), _share(data, DIGITS), len(distinct) / n, min(2.0, sum(map(len, words)) / n / 10),
        min(2.0, np.log1p(len(words)) / 6), last / n, 1 - len(set(lines)) / max(1, len(lines)), _share(data, b"|"), _share(data, b"!"),
    ]
    crc = zlib.crc32
    return np.fromiter((crc(w) >> 32 - WORD_BITS for w in distinct), np.uint32, len(distinct)), shape


@dataclass
class Model:
    """Weights by hashed word, of the standardised shape, and the intercept."""

    words: np.ndarray
    shape: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    bias: float

    def logit(self, words: np.ndarray, shape: np.ndarray) -> float:
        return float(self.words[words].sum() + self.shape @ np.clip((shape - self.middle) / self.spread, -5, 5) + self.bias)


def fit(cols: list[np.ndarray], shapes: np.ndarray, against: np.ndarray, chosen: np.ndarray) -> Model:
    """Logistic regression on the ``chosen`` hashed words and on the shape; ``cols`` are a row's places in ``chosen``.

    A round goes over the rows in portions, so what it holds beside the sample is small.
    """
    n, yes = len(against), int(against.sum())
    weights, middle, spread = np.zeros(1 << WORD_BITS, np.float32), np.zeros(SHAPE), np.ones(SHAPE)
    if yes in (0, n):
        return Model(weights, np.zeros(SHAPE), middle, spread, -4.0)
    middle, spread = shapes.mean(0), np.maximum(shapes.std(0), 1e-3)
    x = np.clip((shapes - middle) / spread, -5, 5)
    parts = []
    for low in range(0, n, PORTION):
        own = cols[low : low + PORTION]
        parts.append((slice(low, low + len(own)), np.repeat(np.arange(len(own), dtype=np.uint16), [len(c) for c in own]), np.concatenate(own)))
    k = len(chosen)
    w, v, b = np.zeros(k), np.zeros(SHAPE), float(np.log(yes / (n - yes)))
    past_w, past_v, past_b = np.full(k, 1e-8), np.full(SHAPE, 1e-8), 1e-8
    for _ in range(ROUNDS):
        gw, gv, gb = DECAY * w, DECAY * v, 0.0
        for at, row, col in parts:
            here = x[at]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(here)) + here @ v + b, -30, 30)))
            error = (p - against[at]) / n
            gw, gv, gb = gw + np.bincount(col, error[row], k), gv + here.T @ error, gb + error.sum()
        past_w, past_v, past_b = past_w + gw**2, past_v + gv**2, past_b + gb**2
        w, v, b = w - RATE * gw / np.sqrt(past_w), v - RATE * gv / np.sqrt(past_v), b - RATE * gb / np.sqrt(past_b)
    weights[chosen] = w
    return Model(weights, v, middle, spread, float(b))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The labelled rows that models are fitted on: ``__id``, the labels, ``words`` and ``shape``; at most ``SAMPLE``, whatever the ids.

    Of several documents of an id the one whose text has the smallest hash stands for it.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(*(F.max(column).cast("long").alias(column) for _, column, _ in TARGETS))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(data).alias("__text"), data.alias("data"))
    names = ["__id", "__text", *(c for _, c, _ in TARGETS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                got = [features(data) for data in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array([w.astype(np.int32) for w, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.list_(pa.float64()))], names=[*names, "words", "shape"])

    # the sample is bounded, so it is the side that goes to the texts
    joined = texts.join(F.broadcast(known), "__id").select(*names, "data")
    schema = f"__id {joined.schema[0].dataType.simpleString()}, __text long, " + ", ".join(f"{c} long" for _, c, _ in TARGETS) + ", words array<int>, shape array<double>"
    rows = joined.mapInArrow(run, schema)
    first = rows.groupBy("__id").agg(F.min_by(F.struct(*names[2:], "words", "shape"), "__text").alias("x")).select("__id", "x.*")
    return kept(first, "sample")


def _chosen(rows: DataFrame, n: int, yes: int) -> np.ndarray:
    """The at most ``CHOSEN`` hashed words that tell the kinds apart best (``y``, ``words`` in ``rows``), counted in Spark."""
    held = rows.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("yes"))
    expected = F.col("n") * (yes / n)
    distance = F.when(F.col("n") >= 4, (F.col("yes") - expected) ** 2 / expected).otherwise(0.0)
    best = held.select("w", distance.alias("d")).where(F.col("d") > 3.0).orderBy(F.desc("d"), "w").limit(CHOSEN)
    return np.sort(np.array([r.w for r in best.collect()], np.int64))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Model]:
    """A model for each target, from the labelled rows with the smallest hashes of their ids.

    Words are counted and chosen in Spark; what the driver sees of a row is its labels, its shape and its chosen words.
    """
    every = sample(docs, labels, id_col, text_col)
    models = {}
    for name, column, against in TARGETS:
        rows = every.where(F.col(column).isNotNull()).select("__id", (F.col(column) == against).cast("long").alias("y"), "words", "shape")
        n, yes = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        if yes in (0, n):
            models[name] = fit([], np.zeros((0, SHAPE)), np.zeros(0), np.empty(0, np.int64))
            continue
        chosen = _chosen(rows, n, yes)

        def placed(batches: Iterable[pa.RecordBatch], chosen: np.ndarray = chosen) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = []
                for words in batch.column(2).to_pylist():
                    words = np.sort(np.array(words, np.int64))
                    cols.append(np.flatnonzero(np.isin(chosen, words, assume_unique=False)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols, pa.binary()), batch.column(3)], names=["__id", "y", "cols", "shape"])

        kind = rows.schema[0].dataType.simpleString()
        got = rows.mapInArrow(placed, f"__id {kind}, y long, cols binary, shape array<double>").orderBy("__id").select("y", "cols", "shape").toArrow()
        cols = [np.frombuffer(x, "<u2") for x in got["cols"].to_pylist()]
        shapes = np.array(got["shape"].to_pylist(), np.float64).reshape(-1, SHAPE)
        models[name] = fit(cols, shapes, got["y"].to_numpy().astype(np.float64), chosen)
    release(docs.sparkSession, every)
    return models


def evidence(docs: DataFrame, models: dict[str, Model], text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` (all) and per target the log odds that the document's own text gives."""
    names = docs.columns if columns is None else columns
    sent = docs.sparkSession.sparkContext.broadcast(models)
    at = len(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        known = list(sent.value.values())
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                logits = []
                for data in part.column(at).to_pylist():
                    words, shape = features(data)
                    shape = np.array(shape)
                    logits.append([m.logit(words, shape) for m in known])
                each = np.array(logits, np.float64).reshape(-1, len(known))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *(pa.array(each[:, k]) for k in range(len(known)))], names=[*names, *(f"__{t}" for t in sent.value)])

    given = docs.select(*names, F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("__data"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:at]) + "".join(f", __{t} double" for t in models)
    return given.mapInArrow(run, schema)


def _chance(logit):
    return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))


def _strength(sites: DataFrame, rate, n: str, over) -> float:
    """The prior's strength by the method of moments: how far the rates differ beyond what their sizes explain."""
    spread, middle, total, count = sites.agg(F.sum(F.col(n) * (rate - over) ** 2), F.avg(over), F.sum(n), F.count("*")).first()
    if not total:
        return 1.0
    noise = middle * (1 - middle)
    beyond = max(spread / total - noise / (total / count), 1e-6)
    return min(max(noise / beyond - 1, 1.0), 1e6)


def site_rates(scored: DataFrame, models: dict[str, Model], host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """A row a site: ``host``, ``path``, their rows ``n`` and ``host_n``, and per target ``<t>_sum`` and ``<t>_host`` (sums of the chances),
    ``<t>_all`` (the rate of all documents), ``<t>_host_k`` and ``<t>_path_k`` (the strengths of the priors) and ``<t>_rate``, the shrunk rate of the path.
    """
    sums = [F.sum(_chance(F.col(f"__{t}"))).alias(f"{t}_sum") for t in models]
    paths = kept(scored.groupBy(F.col(host_col).alias("host"), F.col(path_col).alias("path")).agg(F.count("*").alias("n"), *sums), "paths")
    hosts = kept(paths.groupBy(F.col("host").alias("__host")).agg(F.sum("n").alias("host_n"), *(F.sum(f"{t}_sum").alias(f"{t}_host") for t in models)), "hosts")
    total, *each = hosts.agg(F.coalesce(F.sum("host_n"), F.lit(0)), *(F.sum(f"{t}_host") for t in models)).first()
    out = paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    for t, whole in zip(models, each, strict=True):
        rate = F.lit(whole / total if total else 0.5)
        k = _strength(hosts, F.col(f"{t}_host") / F.col("host_n"), "host_n", rate)
        above = (F.col(f"{t}_host") + k * rate) / (F.col("host_n") + k)
        own = _strength(out, F.col(f"{t}_sum") / F.col("n"), "n", above)
        out = out.withColumns({f"{t}_all": rate, f"{t}_host_k": F.lit(k), f"{t}_path_k": F.lit(own), f"{t}_rate": (F.col(f"{t}_sum") + own * above) / (F.col("n") + own)})
    found = kept(out, "sites")
    release(scored.sparkSession, paths, hosts)
    return found


def _at_sites(scored: DataFrame, sites: DataFrame) -> DataFrame:
    """``scored`` with its site's row, by ``__host`` and ``__path``.

    Up to ``SITES_SENT`` sites are sent to all tasks. More are joined, and sites
    with a thousandth of all rows, a thousand at most, by salt: no task gets one whole.
    """
    n, rows = sites.agg(F.count("*"), F.sum("__n")).first()
    if n <= SITES_SENT:
        return scored.join(F.broadcast(sites), ["__host", "__path"])
    hot = F.col("__n") * HOT >= F.lit(rows)
    salts = F.when(hot, F.lit(SALTS)).otherwise(F.lit(1))
    spread = sites.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    busy = sites.where(hot).select("__host", "__path", F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*scored.columns[:1], *(c for c in scored.columns if c.startswith("__"))), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    return scored.join(F.broadcast(busy), ["__host", "__path"], "left").withColumn("__salt", salt).drop("__hot").join(spread, ["__host", "__path", "__salt"])


def decide(scored: DataFrame, sites: DataFrame, models: dict[str, Model], host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``scored`` with ``__keep`` and, per target, ``__<target>_p``: the posterior. A site's rates are those without the document itself."""
    odds = lambda p: F.log(p / (1 - p))
    inside = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    named_as = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))  # noqa: E731 - a site without a name is a site
    named = scored.withColumns({"__host": named_as(F.col(host_col)), "__path": named_as(F.col(path_col))})
    fields = ["n", "host_n", *(f"{t}_{x}" for t in models for x in ("sum", "host", "all", "host_k", "path_k"))]
    known = sites.select(named_as(F.col("host")).alias("__host"), named_as(F.col("path")).alias("__path"), F.col("n").alias("__n"), F.struct(*fields).alias("__s"))
    out = _at_sites(named, known)
    found = {}
    for t in models:
        s, own = (lambda x: F.col(f"__s.{x}")), _chance(F.col(f"__{t}"))
        above = (s(f"{t}_host") - own + s(f"{t}_host_k") * s(f"{t}_all")) / (s("host_n") - 1 + s(f"{t}_host_k"))
        rate = (s(f"{t}_sum") - own + s(f"{t}_path_k") * above) / (s("n") - 1 + s(f"{t}_path_k"))
        sway = F.greatest(F.least(odds(inside(rate)) - odds(inside(s(f"{t}_all"))), F.lit(SWAY)), F.lit(-SWAY))
        found[f"__{t}_p"] = _chance(F.col(f"__{t}") + sway)
    out = out.withColumns(found)
    reject = F.lit(False)
    for t in models:
        reject = reject | (F.col(f"__{t}_p") >= REJECT)
    return out.withColumn("__keep", ~reject)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row a document: ``id_col``, ``host``, ``path``, ``p_poor`` and ``p_toxic`` (posteriors), ``keep``."""
    models = train(docs, labels, id_col)
    named = docs.select(F.col(id_col), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col("text").alias("__text"))
    scored = kept(evidence(named, models, "__text", [id_col, "host", "path"]), "evidence")
    found = decide(scored, site_rates(scored, models, "host", "path"), models, "host", "path")
    return found.select(id_col, "host", "path", F.col("__poor_p").alias("p_poor"), F.col("__toxic_p").alias("p_toxic"), F.col("__keep").alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """All columns of the documents that are not rejected."""
    models = train(docs, labels, id_col)
    named = docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col("text").alias("__text"))
    sites = site_rates(evidence(named, models, "__text", ["host", "path"]), models, "host", "path")
    return decide(evidence(docs, models), sites, models, host_col, path_col).where("__keep").select(*docs.columns)
