"""Operator 7: language identification in two levels of linear support vector machines.

A text is the square-rooted, length-normalised histogram of hashed byte trigrams of its letters. One-versus-rest
machines choose the language family, then one-versus-one machines vote among the family's languages. Both levels learn
from one bounded, stratified sample of labelled rows whose histograms are made on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm.common import need, small_batches, tidy, without

DIMS = 4096
#: Distinct labelled texts to learn from, all languages together: 13 MB of histograms on their way, 26 MB in use.
SAMPLE_ROWS = 1600
#: Distinct texts a language may have in the sample however many languages share it.
LEAST = 8
#: Families by language code; a code not named here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi ur bn mr pa gu ne",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Texts whose histograms are not empty.
_LETTERED = "[A-Za-z\\x{80}-\\x{10FFFF}]"
_KEPT = np.array([ord(" ")] * 256, np.uint8)
_KEPT[ord("a") : ord("z") + 1] = range(ord("a"), ord("z") + 1)
_KEPT[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
_KEPT[128:] = range(128, 256)


def family(code: str) -> str:
    return _FAMILY.get(code.split("-")[0].split("_")[0].lower(), code)


def histogram(text: str) -> np.ndarray:
    """Unit vector of square roots of trigram counts; digits and punctuation are gaps between words."""
    data = _KEPT[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b"  ", np.uint8)].astype(np.uint32)
    code = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    code = code[(data[:-2] != 32) | (data[1:-1] != 32)]
    place = (code * np.uint32(2654435761)) >> np.uint32(20)
    h = np.sqrt(np.bincount(place, minlength=DIMS).astype(np.float32))
    norm = float(np.sqrt((h * h).sum()))
    return h / norm if norm else h


def _machine(x: np.ndarray, y: np.ndarray, epochs: int = 30, c: float = 10.0) -> tuple[np.ndarray, float, float]:
    """Linear support vector machine by dual coordinate descent (squared hinge): weights with bias last, and the scale
    and shift of a logistic calibration of its margins. Classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    n = len(x)
    cost = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * c
    alpha, w = np.zeros(n), np.zeros(x.shape[1])
    norm = np.einsum("ij,ij->i", x, x)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(n):
            g = y[i] * float(x[i] @ w) - 1 + alpha[i] / (2 * cost[i])
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(alpha[i] - g / (norm[i] + 1 / (2 * cost[i])), 0.0)
            worst = max(worst, abs(new - alpha[i]))
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
        if worst < 1e-3:
            break
    margin, a, b = x @ w, 1.0, 0.0
    for _ in range(100):  # gradient steps of the logistic loss
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        e = p - (y > 0) * 0.98 - 0.01
        a, b = max(0.1, a - 2.0 * float((e * margin).mean())), b - 2.0 * float(e.mean())
    return w.astype(np.float32), a, b


class Model:
    """families: name -> languages. top: one machine a family; pairs: one machine for each two languages of a family."""

    def __init__(self, codes: list[str], x: np.ndarray):
        names = sorted(set(codes))
        self.families: dict[str, list[str]] = {}
        for n in names:
            self.families.setdefault(family(n), []).append(n)
        code = np.array(codes)
        kin = np.array([family(c) for c in codes])
        top = sorted(self.families)
        self.top = [(f, *_machine(x, np.where(kin == f, 1, -1))) for f in top] if len(top) > 1 else []
        self.pairs = {f: [(p, q, *_machine(x[(code == p) | (code == q)], np.where(code[(code == p) | (code == q)] == p, 1, -1))) for i, p in enumerate(ls) for q in ls[i + 1 :]] for f, ls in self.families.items()}

    def predict(self, text: str) -> tuple[str, float]:
        h = histogram(text)
        sure = lambda w, a, b: 1 / (1 + np.exp(-np.clip(a * float(w[:-1] @ h + w[-1]) + b, -30, 30)))
        kin, score = next(iter(self.families)), 1.0
        if self.top:
            score, kin = max((sure(*m), f) for f, *m in self.top)
        votes = {n: [0, 0.0] for n in self.families[kin]}
        for p, q, *m in self.pairs[kin]:
            s = sure(*m)
            votes[p if s >= 0.5 else q][0] += 1
            votes[p][1] += s
            votes[q][1] += 1 - s
        best = max(sorted(votes), key=lambda n: votes[n])
        if len(votes) > 1:
            score *= votes[best][1] / (len(votes) - 1)
        return best, float(score)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [histogram(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], names=["lang", "h"])


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """From rows (text, lang), both not null: an even sample of languages of about sample_rows distinct texts, chosen by
    their hashes, so it doesn't hang on partitions or on copies; each language's text of the least hash is always in.
    Every labelled value is learned; of more than sample_rows / LEAST of them each keeps LEAST texts, and the sample
    grows with their number. None if there are no rows with letters."""
    labelled = labelled.where("text is not null and lang is not null").where(F.col("text").rlike(_LETTERED))
    labelled = labelled.select("text", "lang", F.xxhash64("text").alias("k"))
    place = F.pmod("k", F.lit(1_000_000))
    top = labelled.select("lang", "k").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()
    if not top:
        return None
    each = max(LEAST, sample_rows // len(top))
    upto = F.create_map(*[F.lit(v) for r in top for v in (r["lang"], max(r["first"] + 1.0, min(1.0, each / r["n"]) * 1_000_000))])
    picked = labelled.where(place < F.coalesce(F.try_element_at(upto, F.col("lang")), F.lit(0.0))).select("text", "lang").distinct()
    got = picked.select("text", "lang").mapInArrow(_histograms, "lang string, h binary").dropDuplicates(["lang", "h"]).orderBy(F.xxhash64("h"), "lang").limit(2 * each * len(top)).collect()
    got = [r for r in got if np.frombuffer(r["h"], np.float16).any()]
    codes, x = [r["lang"] for r in got], np.stack([np.frombuffer(r["h"], np.float16) for r in got]).astype(np.float32) if got else None
    del got
    return Model(codes, x) if codes else None


def _predictions(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t) if t and model and any(map(str.isalpha, t)) else ("und", 0.0) for t in batch.column("text").to_pylist()]
            cols = [batch.column(n) for n in keep] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score"])

    return tidy(run)


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """docs (text and any others; keep names those to return, all by default) with lang_pred and score (0 to 1).

    A null text, one without letters (Unicode's category L), and any text without a model: und with score 0. Only text
    is an input. Columns of docs called lang_pred or score give way. A table without rows gives none; rows repeated
    whole each get their result.
    """
    need(docs, "text")
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "lang_pred", "score")
    keep = docs.columns if keep is None else keep
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_predictions(spark.sparkContext.broadcast(model), keep), f"{typed}, lang_pred string, score double")
