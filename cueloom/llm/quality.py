"""Quality and toxicity of documents: a word classifier joined with site posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm import tokens
from cueloom.llm.common import checked, known, staged, unused, widened

SAMPLE = 12_000
SPACE = 1 << 18
HEADS = ("quality", "toxic")
MOST_PRIOR = 1_000.0
LEAST_CHI = 12.0
_U = np.uint64


def _style(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whole-text measures of every text, each cut into 16 steps: one feature per measure and step."""
    n = len(offsets) - 1
    bytes_ = np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    share = lambda mask: np.bincount(owner[mask], minlength=n) / bytes_
    words = np.maximum(np.bincount(rows, minlength=n), 1)
    order = np.lexsort((hashes, rows))
    repeat = np.zeros(len(hashes), bool)
    repeat[1:] = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    sign = ~tokens.LETTERS[data] & tokens.PLAIN[data]
    measures = [
        share(upper) * 4, share(digit) * 8, share(sign) * 4, np.bincount(rows[order][repeat], minlength=n) / words,
        np.bincount(rows, weights=(ends - begins).astype(float), minlength=n) / words / 12, np.log2(words + 1) / 16,
    ]
    return np.stack([np.minimum((m * 16).astype(np.int64), 15) + 16 * i for i, m in enumerate(measures)], axis=1)


def features(column: pa.Array):
    """(first row, number of rows, row, feature) of runs of texts: the distinct words and the style steps of each."""
    for row, data, offsets in tokens.text_chunks(column):
        hashes, rows, begins, ends = tokens.words(tokens.fold(data), offsets, tokens.LETTERS)
        style = _style(data, offsets, rows, hashes, begins, ends)
        n = len(offsets) - 1
        slot = (hashes % _U(SPACE)).astype(np.int64) + 16 * style.shape[1]
        pair = np.unique(rows * (SPACE + 1024) + slot)
        yield row, n, np.concatenate([np.repeat(np.arange(n), style.shape[1]), pair // (SPACE + 1024)]), np.concatenate([style.ravel(), pair % (SPACE + 1024)])


def _vectors(batches):
    for batch in batches:
        parts = [(row + rows, feats.astype(np.int32)) for row, _, rows, feats in features(batch.column(2))]
        rows, feats = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(rows, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feats[order]))], ["quality", "toxic", "features"])


class Model:
    """Weights and an intercept for each head, and the share of positive labels it was fitted on."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, base: np.ndarray) -> None:
        self.weights, self.bias, self.base = weights, bias, base

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.tile(self.bias, (len(column), 1))
        for row, n, rows, feats in features(column):
            for h, w in enumerate(self.weights):
                out[row : row + n, h] += np.bincount(rows, weights=w[feats], minlength=n)
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = 300, ridge: float = 0.1) -> Model:
    """Logistic regression of the labels on words and style, on at most ``sample`` labelled rows, those of the smallest hashes.

    Rows without a label of a head don't count for that head. Without labels at all everything passes.
    """
    picked = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").select(
        "doc_id", *[F.col(h).cast("int").alias(h) for h in HEADS]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", known().alias("text")).join(F.broadcast(picked), "doc_id")
    # Rows that share an id are one, so that no more than ``sample`` reach the driver.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", *HEADS)).alias("row")).select(*[f"row.{h}" for h in HEADS], "row.text")
    got = rows.mapInArrow(_vectors, "quality int, toxic int, features array<int>").toArrow()
    weights, bias, base = np.zeros((2, SPACE + 1024)), np.array([20.0, -20.0]), np.array([0.5, 0.5])
    if not got.num_rows:
        return Model(weights, bias, base)
    lists = got.column("features").combine_chunks()
    feats = lists.flatten().to_numpy()
    counts = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(counts)), counts)
    used, slot = np.unique(feats, return_inverse=True)
    for h, head in enumerate(HEADS):
        y = got.column(head).to_numpy().astype(float)
        live = ~np.isnan(y)
        if not live.any() or len(np.unique(y[live])) < 2:
            if live.any():
                bias[h] = 20.0 if y[live][0] > 0 else -20.0
            continue
        positive = np.nan_to_num(y)
        base[h] = y[live].mean()
        # Most words say nothing: only those stay whose counts in the two classes differ beyond chance (chi-square).
        both = np.bincount(slot, weights=live[owner].astype(float), minlength=len(used))
        hits = np.bincount(slot, weights=(positive * live)[owner], minlength=len(used))
        n, n_hits = live.sum(), positive.sum()
        expected = both * n_hits / n
        chi = (hits - expected) ** 2 / np.maximum(expected * (1 - n_hits / n) * (1 - both / n), 1e-9)
        keep = np.flatnonzero((chi >= LEAST_CHI) & (both >= 3))
        slots = np.full(len(used), -1)
        slots[keep] = np.arange(len(keep))
        inside = slots[slot] >= 0
        feat, doc = slots[slot[inside]], owner[inside]
        w, b, gw, gb = np.zeros(len(keep)), float(np.log(base[h] / (1 - base[h]))), np.full(len(keep), 1e-8), 1e-8
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=w[feat], minlength=len(counts)) + b, -30, 30)))
            miss = np.where(live, p - positive, 0.0)
            d = np.bincount(feat, weights=miss[doc], minlength=len(keep)) + ridge * w
            gw += d * d
            w -= 0.5 * d / np.sqrt(gw)
            gb += miss.sum() ** 2
            b -= 0.5 * miss.sum() / np.sqrt(gb)
        weights[h, used[keep]] = w
        bias[h] = b
    return Model(weights, bias, base)


def _scorer(model: Model, quality: str, toxic: str):
    def run(batches):
        for batch in batches:
            scores = model.logits(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores[:, 0]), pa.array(scores[:, 1])], names=[*batch.schema.names[:-1], quality, toxic])

    return run


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(share: Column) -> Column:
    return F.log(share / (1 - share))


def site_priors(evidence: DataFrame) -> DataFrame:
    """Posterior shares of hosts and paths from (host, path, quality, toxic): sums per path, then per host, then overall.

    A host is shrunk toward the whole, a path toward its host. How strongly follows from the spread between sites
    (method of moments). Returns host, path, n, and for each head the path's posterior and the share overall.
    """
    sums = [F.sum(h).alias(h) for h in HEADS]
    paths = staged(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums), "site-paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("n"), *sums), "site-hosts")
    total = hosts.agg(F.sum("n").alias("n"), *sums).first()
    n_all = total.n or 1
    share = {h: min(max((total[h] or 0.0) / n_all, 1e-4), 1 - 1e-4) for h in HEADS}

    def strength(table: DataFrame, head: str) -> float:
        """Rows' worth of a beta prior: from the variance of the sites' shares beyond that of sampling."""
        m = share[head]
        r = table.agg(
            F.sum(F.col("n") * (F.col(head) / F.col("n") - m) ** 2).alias("spread"), F.count(F.lit(1)).alias("sites"),
            F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("square")).first()
        if not r.sites or r.sites < 2:
            return MOST_PRIOR
        weight = r.n - r.square / r.n
        between = (r.spread - (r.sites - 1) * m * (1 - m)) / weight if weight > 0 else 0.0
        return float(min(MOST_PRIOR, max(1.0, m * (1 - m) / between - 1))) if between > 0 else MOST_PRIOR

    out = paths
    by_host = hosts
    for h in HEADS:
        k = strength(hosts, h)
        by_host = by_host.withColumn(f"{h}_host", (F.col(h) + k * share[h]) / (F.col("n") + k))
    out = out.join(by_host.select("host", *[f"{h}_host" for h in HEADS]).hint("shuffle_hash"), out["host"].eqNullSafe(by_host["host"])).drop(by_host["host"])
    for h in HEADS:
        k = strength(paths, h)
        out = out.withColumn(f"{h}_path", (F.col(h) + k * F.col(f"{h}_host")) / (F.col("n") + k)).withColumn(f"{h}_all", F.lit(share[h]))
    return staged(out.select("host", "path", "n", *[f"{h}_{x}" for h in HEADS for x in ("path", "all")]), "site-priors")


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> tuple[DataFrame, str, str]:
    """The table with its chances of being good and of being toxic, and the names of these two columns.

    A document's own evidence is the logit of a classifier of its words and style. The prior of its site moves that
    logit: a site is a host and a path of it (here source and language), its prior the mean of the classifier's
    chances over its documents, shrunk toward its host and the host toward the whole.

    Null texts count as empty; null hosts and paths are sites of their own; repeated rows are scored each, and null ids
    as well. An empty table gives no rows. All columns stay, whatever their names.
    """
    model = fit(docs, labels, sample)
    names = {h: unused(docs, f"p_{h}") for h in HEADS}
    logit = {h: unused(docs, f"logit_{h}") for h in HEADS}
    passage, site_host, site_path = (unused(docs, x) for x in ("passage", "site_host", "site_path"))
    rows = docs.withColumn(passage, known()).mapInArrow(
        _scorer(model, logit["quality"], logit["toxic"]), widened(docs, **{logit[h]: "double" for h in HEADS}))
    evidence = docs.select(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), known().alias("passage")).mapInArrow(
        _scorer(model, *HEADS), "host string, path string, quality double, toxic double")
    priors = site_priors(evidence.select("host", "path", *[_chance(F.col(h)).alias(h) for h in HEADS]))
    moves = {h: unused(docs, f"move_{h}") for h in HEADS}
    sites = checked(priors.select(
        F.col("host").alias(site_host), F.col("path").alias(site_path),
        *[(_logit(F.col(f"{h}_path")) - _logit(F.col(f"{h}_all"))).alias(moves[h]) for h in HEADS]), 80)
    joined = rows.join(sites, F.col(host).cast("string").eqNullSafe(F.col(site_host)) & F.col(path).cast("string").eqNullSafe(F.col(site_path)), "left")
    chances = [_chance(F.col(logit[h]) + F.coalesce(moves[h], F.lit(0.0))).alias(names[h]) for h in HEADS]
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *chances), names["quality"], names["toxic"]


def keepers(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows whose chance of being good is ``least`` or more and whose chance of being toxic is below it.

    Chances are those of ``scored``. All columns stay, whatever their names. Rows without an id, with a null or empty
    text, and repeated rows are judged by themselves and their site like others; without labels every row stays; texts
    of any length are read as a whole; an empty table stays empty.
    """
    rows, good, toxic = scored(docs, labels, **options)
    return rows.filter((F.col(good) >= least) & (F.col(toxic) < least)).select(*[F.col(f"`{c}`") for c in docs.columns])
