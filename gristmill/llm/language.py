"""Language identification by Bayesian fusion of text, markup, address and host evidence.

The posterior of a language is the product of

* the likelihood of the text: letter trigrams of the whole text under one multinomial model per
  language, tempered because neighbouring trigrams overlap;
* the likelihood of the declared markup language and of the address suffix, from grouped counts
  of what rows of each language declare;
* the prior of the host: counts of text posteriors per host, smoothed towards its domain, and
  that towards all rows, by Dirichlet weights. A row's own share is taken out of the counts it
  meets, so it is not evidence for itself.

A further class ``und`` stands for text that no known language explains better than chance. Letters are ASCII letters and digits and all other
characters beyond ASCII. Rows
are scored once; all that moves afterwards is one short array per row. Aggregates are partial
before they are shuffled, so a host with a third of all rows is no burden; the small tables of
counts are broadcast only after their size was checked.

The languages are the labels of all rows, by their language part and without a least or largest
number. Trigram models are fitted on a bounded sample of labelled texts (``per_language`` rows for
each language, of each the first ``longest`` characters). Everything else covers all rows. Time
and memory grow with the number of languages. A language with under ``LEAST_GRAMS`` trigrams of
text has no model. A row that declares a language without model and would be rejected
passes under that language, marked by a confidence of 0.

Defined cases: null and empty texts, and texts without letters, are ``und`` with no confidence and
rejected; a null declaration or one of ``und``, an unknown suffix or host is no evidence; repeated rows are judged
alike; without labelled texts every row that declares no language is ``und``; other columns may
be carried along.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gristmill.llm.decontaminate import GAP, folded
from gristmill.llm.tables import free_name, in_batches, small
from gristmill.llm.words import slices, text_bytes
from gristmill.plans.session import checkpoint

BUCKETS = 1 << 16
NONE = "und"
TEMPER = 0.2  # share of a trigram's log-likelihood that counts
WEIGHT = 10.0  # rows that a parent counts for
BLANK = 0x20
LEAST_GRAMS = 20  # trigrams of labelled text below which a model is no better than chance


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte; BUCKETS where there is none.

    Signs and blanks are one kind of gap, and a trigram has a letter in its middle.
    """
    letters = folded(data)
    letters[GAP[letters]] = BLANK
    out = np.full(len(data), BUCKETS, dtype=np.int32)
    if len(data) < 3:
        return out
    a, b, c = (letters[i : len(data) - 2 + i].astype(np.uint32) for i in range(3))
    code = ((a << np.uint32(16)) | (b << np.uint32(8)) | c) * np.uint32(2654435761)
    out[:-2] = np.where(b == BLANK, BUCKETS, code >> np.uint32(16))
    edges = offsets[1:][offsets[1:] > 0]
    out[edges - 1] = BUCKETS
    out[np.maximum(edges - 2, 0)] = BUCKETS
    return out


@dataclass
class Model:
    languages: list[str]  # the last is NONE
    table: np.ndarray  # log-likelihoods [language, bucket], the last bucket is 0

    def likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text under each language, and its number of trigrams."""
        found = trigrams(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        counts = np.zeros(len(offsets) - 1, dtype=np.int64)
        if len(full):
            for k, row in enumerate(self.table):
                out[full, k] = np.add.reduceat(row[found], offsets[full], dtype=np.float64)
            counts[full] = np.add.reduceat((found < BUCKETS).astype(np.int64), offsets[full])
        return out, counts


def fit_language(per_language: int):
    def run(table: pa.Table) -> pa.Table:
        """Trigram counts of the ``per_language`` rows with the least hashes; ``n`` rows share a text."""
        table = table.sort_by("hash")
        n = table.column("n").to_numpy()
        taken = np.minimum(n, np.maximum(per_language - (np.cumsum(n) - n), 0))
        used = int((taken > 0).sum())
        data, offsets = text_bytes(pa.array(table.column("text")[:used].to_pylist(), pa.string()))
        weights = np.repeat(taken[:used], np.diff(offsets))
        counts = np.bincount(trigrams(data, offsets), weights, BUCKETS + 1)[:BUCKETS]
        grams = int(counts.sum())
        counts += 0.02
        made = np.log(counts / counts.sum()).astype(np.float32)
        return pa.table({"lang": table.column("lang")[:1], "grams": [grams], "made": pa.array([made.tobytes()], pa.binary())})

    return run


def fit(labelled: DataFrame, per_language: int = 400, longest: int = 20_000) -> Model:
    """Models from ``labelled(text, lang)`` in two scans; rows are chosen by a hash of their text."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), label(F.col("lang")).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.select("lang", F.xxhash64("text").alias("hash"), F.substring("text", 1, longest).alias("text"))
    # Leading zeros of the hash, from the least hash on: a level halves the rows of the one before.
    rows = rows.withColumn("level", F.lit(64) - F.length(F.bin(F.expr("hash ^ (-9223372036854775807L - 1L)"))))
    sizes: dict[str, dict] = {}
    for r in rows.groupBy("lang", "level").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r.lang, {})[r.level] = r.n
    table, languages = [], []
    if sizes:
        levels = {lang: max((v for v in n if sum(m for u, m in n.items() if u >= v) >= per_language), default=0) for lang, n in sizes.items()}
        near = small(labelled.sparkSession.createDataFrame(list(levels.items()), "lang string, least int"))
        sample = rows.join(near, "lang").where("level >= least").groupBy("lang", "hash").agg(F.count("*").alias("n"), F.min("text").alias("text"))
        for r in sorted(sample.groupBy("lang").applyInArrow(fit_language(per_language), "lang string, grams long, made binary").collect(), key=lambda r: r.lang):
            if r.grams >= LEAST_GRAMS:
                languages.append(r.lang)
                table.append(np.r_[np.frombuffer(r.made, dtype=np.float32), np.float32(0)])
    table.append(np.r_[np.full(BUCKETS, -np.log(BUCKETS)), 0.0].astype(np.float32))
    return Model([*languages, NONE], np.array(table))


def text_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` without ``text``, plus ``evidence`` (tempered log-likelihoods), ``share`` (the
    posterior of the text alone, zeros without letters) and ``grams``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c != "text"]
    inner = rows.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found, grams = shared.value.likelihoods(*text_bytes(part.column("text")))
                evidence = TEMPER * found
                share = softmax(evidence) * (grams > 0)[:, None]
                made = [lists(evidence), lists(share), pa.array(grams)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*keep, "evidence", "share", "grams"])

    schema = ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in keep)
    return in_batches(inner, run, f"{schema}, evidence array<double>, share array<double>, grams long")


def softmax(values: np.ndarray) -> np.ndarray:
    raised = np.exp(values - values.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` numbers as a matrix; a null is a row of NaN."""
    out = np.full((len(column), width), np.nan)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def summed(name: str, width: int) -> Column:
    """The sum of arrays, place by place."""
    return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(width)])


def rates(rows: DataFrame, column: str, width: int, name: str) -> DataFrame:
    """For each value of ``column``: log P(value | language), with a little mass for any value."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(column).agg(summed("share", width).alias("n"))
    kinds, sums = counted.agg(F.count("*"), summed("n", width)).first()
    mass = F.array(*[F.lit((x or 0.0) + 0.5 * max(kinds, 1)) for x in sums or [0.0] * width])
    return counted.select(
        F.col(column).alias(f"__{column}"), F.zip_with("n", mass, lambda x, a: F.log((x + 0.5) / a)).alias(name)
    )


def identify(rows: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Languages of ``rows(..., text, declared, suffix, domain, host)``.

    The other columns are carried along; ``lang, confidence, text_lang, accepted`` are added. A row
    is accepted if it has letters, is not ``und`` and its posterior reaches ``least``, or if it has
    letters other than digits and the language it declares has no model.
    """
    width = len(model.languages)
    worded = free_name(rows, "worded")
    scored = checkpoint(text_evidence(rows.withColumn(worded, F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))), model))
    whole = scored.agg(summed("share", width)).first()[0] or [0.0] * width
    whole = [x or 0.0 for x in whole]
    total = sum(whole)
    everywhere = np.array([(x + 1.0) / (total + width) for x in whole])
    tables = {}
    for level in ("host", "domain"):
        tables[level] = small(scored.where(F.col(level).isNotNull()).groupBy(F.col(level).alias(f"__{level}")).agg(summed("share", width).alias(f"n_{level}")))
    for kind in ("declared", "suffix"):
        tables[kind] = small(rates(scored, kind, width, f"p_{kind}"))
    found = scored
    for name, counted in tables.items():
        found = found.join(counted, F.col(name) == F.col(f"__{name}"), "left").drop(f"__{name}")

    keep = [c for c in rows.columns if c not in ("text", "declared", "suffix", "domain", "host")]
    names, modelled = np.array(model.languages), set(model.languages)

    def smoothed(counts: np.ndarray, own: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Dirichlet mean of the other rows' counts and the parent; the parent where there are none."""
        others = np.maximum(counts - own, 0.0)
        mixed = (others + WEIGHT * parent) / (others.sum(axis=1, keepdims=True) + WEIGHT)
        return np.where(np.isnan(mixed), parent, mixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = {c: matrix(batch.column(c), width) for c in ("evidence", "share", "n_host", "n_domain", "p_declared", "p_suffix")}
            prior = smoothed(part["n_domain"], part["share"], np.broadcast_to(everywhere, part["share"].shape))
            prior = smoothed(part["n_host"], part["share"], prior)
            said = np.nan_to_num(part["p_declared"]) + np.nan_to_num(part["p_suffix"])
            posterior = softmax(part["evidence"] + np.log(prior) + said)
            letters = batch.column("grams").to_numpy() > 0
            best = np.where(letters, names[posterior.argmax(axis=1)], NONE)
            confidence = np.where(letters, posterior.max(axis=1), 0.0)
            alone = np.where(letters, names[part["share"].argmax(axis=1)], NONE)
            accepted = (best != NONE) & (confidence >= least)
            declared = np.array(batch.column("declared").to_pylist(), dtype=object)
            passed = letters & batch.column(worded).to_numpy(zero_copy_only=False) & ~accepted & np.array([d is not None and d not in modelled for d in declared], dtype=bool)
            best, confidence = np.where(passed, declared, best), np.where(passed, 0.0, confidence)
            made = [pa.array(best, pa.string()), pa.array(confidence), pa.array(alone, pa.string()), pa.array(accepted | passed)]
            kept = batch.select(keep)
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*keep, "lang", "confidence", "text_lang", "accepted"])

    used = found.select(*keep, "evidence", "share", "n_host", "n_domain", "p_declared", "p_suffix", "grams", "declared", worded)
    schema = "".join(f"{c} {used.schema[c].dataType.simpleString()}, " for c in keep)
    return in_batches(used, run, f"{schema}lang string, confidence double, text_lang string, accepted boolean")


def subtag(declared: Column) -> Column:
    """The language part of a declaration such as ``de-AT``; null if there is none."""
    tag = F.regexp_extract(F.lower(declared.cast("string")), r"^\s*([a-z]{2,3})(?![a-z0-9])", 1)
    return F.when(tag != "", tag)


def label(lang: Column) -> Column:
    """The language a label names: its language part, or all of it if it has none; null for ``und``."""
    whole = F.lower(F.trim(lang.cast("string")))
    tag = F.coalesce(subtag(lang), F.when(whole != "", whole))
    return F.when(tag != NONE, tag)


def document_rows(documents: DataFrame, *keep: Column) -> DataFrame:
    """Documents as rows to identify: the language column declares, the source is the host."""
    nothing = F.lit(None).cast("string")
    return documents.select(
        *keep, label(F.col("lang")).alias("declared"), nothing.alias("suffix"), nothing.alias("domain"),
        F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"),
    )


HIDDEN = re.compile(r"<!--.*?-->|<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>|<[^>]*>", re.DOTALL | re.IGNORECASE)


def visible_text(page: str | None) -> str:
    """The text of a page: no tags, scripts, styles or comments; entities resolved."""
    return html.unescape(HIDDEN.sub(" ", page or ""))


def page_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """Pages as rows to identify: markup declares, the address gives suffix, domain and host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                text = pa.array([visible_text(x) for x in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], [*part.schema.names[:-1], "text"])

    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split(F.col("host"), r"\.")
    address = pages.select(
        *keep,
        subtag(F.regexp_extract(F.col("html").cast("string"), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)).alias("declared"),
        F.when(host != "", host).alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    rows = address.select(
        *keep, "declared", F.when(F.size(labels) > 1, F.element_at(labels, -1)).alias("suffix"),
        F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).alias("domain"), "host", "html",
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")
    return in_batches(rows, run, f"{schema}, text string")


def accepted_documents(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known, in their own columns and with their own text.

    The decision is joined back by id and a hash of the text, so no row depends on its order.
    """
    model = fit(documents)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    mark = F.xxhash64(F.col("text"), F.col("lang"), F.col("source"))
    judged = identify(document_rows(documents, key.alias("owner"), mark.alias("print")), model, least)
    rejected = small(judged.where("NOT accepted").select(F.col("owner").alias("__owner"), F.col("print").alias("__print")).distinct())
    return documents.join(rejected, (key == F.col("__owner")) & (mark == F.col("__print")), "left_anti")
