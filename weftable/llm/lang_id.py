"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear support
vector machines between the languages of that family.

Features are hashed byte trigrams of the lower-cased whole text with everything but letters and non-ASCII
bytes turned to spaces; counts are square-rooted and scaled to unit length. Families are told apart by
one-versus-rest linear SVMs, languages inside a family by one SVM for each pair. All are trained here by dual
coordinate descent (squared hinge loss) on at most about PER_LANG labelled rows of each language and IN_ALL together (documented
bounds: rows are taken by a hash of their id, with a rate set from the language's count), and margins become
probabilities by a fitted logistic curve. Families are the table FAMILIES; languages not in it share one.

Defined results: text that is null or has no letter gives `und` with score 0; without any labelled row every
text gives `und`; rows with a null lang or a null id are never learnt from; repeated rows give repeated
results; an empty table gives an empty table. Ties go to the alphabetically first family or language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftable.llm.common import key_and_text, map_blocks, text_udf

#: Labelled rows learnt from: of a language, and of all languages together.
PER_LANG, IN_ALL = 600, 24_000
BINS = 4096
#: Bytes of a text turned to features at once; a longer text is added up piece by piece.
PIECE = 1 << 21

FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "pl", "cs", "sk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("zh", "ja", "ko"), "east-asian"),
}
LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def features(text: str) -> np.ndarray:
    """Unit vector of BINS hashed trigram counts."""
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
    counts = np.zeros(BINS, np.int64)
    for i in range(0, max(1, len(raw) - 2), PIECE):
        x = _KEEP[raw[i : i + PIECE + 2]].astype(np.uint32)
        blank = (x == 32).astype(np.uint8)
        some = blank[:-2] + blank[1:-1] + blank[2:] < 2
        code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[some]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
    v = np.sqrt(counts)
    return (v / max(1e-9, np.sqrt(counts.sum()))).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 40) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge SVM by dual coordinate descent that keeps the weights, so memory is
    that of x; y in {-1, 1}; classes weighted alike."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    ridge = 1 / (2 * c * weight)
    norm = np.einsum("ij,ij->i", x, x).astype(np.float64) + 1.0 + ridge
    alpha, w, bias = np.zeros(len(y)), np.zeros(x.shape[1], x.dtype), 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            g = y[i] * (float(x[i] @ w) + bias) - 1 + alpha[i] * ridge[i]
            step = max(0.0, alpha[i] - g / norm[i]) - alpha[i]
            if step:
                w += x.dtype.type(step * y[i]) * x[i]
                bias += step * y[i]
                alpha[i] += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.append(w, bias).astype(np.float32)


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a probability of margin, by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Model:
    """One column of weights for each machine; machines are ("family", name) or ("pair", one, other)."""

    families: dict[str, list[str]] = field(default_factory=dict)
    machines: list[tuple] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BINS + 1, 0), np.float32))
    curves: list[tuple[float, float]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], families: dict[str, str]) -> Model:
        of = {lang: families.get(lang.lower().split("-")[0], "other") for lang in sorted(set(langs))}
        groups: dict[str, list[str]] = {}
        for lang, fam in of.items():
            groups.setdefault(fam, []).append(lang)
        groups = dict(sorted(groups.items()))
        lang = np.array(langs, object)
        fam = np.array([of[v] for v in langs], object)
        jobs = [(("family", g), np.ones(len(lang), bool), fam == g) for g in groups] if len(groups) > 1 else []
        for names in groups.values():
            jobs += [(("pair", a, b), (lang == a) | (lang == b), lang == a) for a, b in combinations(names, 2)]
        machines, columns, curves = [], [], []
        for name, rows, yes in jobs:
            y = np.where(yes[rows], 1.0, -1.0)
            w = linear_svm(x[rows], y)
            machines.append(name)
            columns.append(w)
            curves.append(logistic(x[rows] @ w[:-1] + w[-1], y))
        return cls(groups, machines, np.stack(columns, 1) if columns else np.zeros((BINS + 1, 0), np.float32), curves)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        p = np.empty((len(x), len(self.machines)))
        for j, (m, (a, b)) in enumerate(zip((x @ self.weights[:-1] + self.weights[-1]).T, self.curves)):
            p[:, j] = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        at = {m: j for j, m in enumerate(self.machines)}
        names = list(self.families)
        if len(names) > 1:
            of = np.stack([p[:, at["family", g]] for g in names], 1)
            of = of / np.maximum(of.sum(1, keepdims=True), 1e-12)
        else:
            of = np.ones((len(x), 1))
        first, out, score = of.argmax(1), [], np.empty(len(x))
        for i, k in enumerate(first.tolist()):
            langs = self.families[names[k]]
            votes = {v: 0 for v in langs}
            sums = {v: 0.0 for v in langs}
            for a, b in combinations(langs, 2):
                q = float(p[i, at["pair", a, b]])
                votes[a if q >= 0.5 else b] += 1
                sums[a] += q
                sums[b] += 1 - q
            best = max(langs, key=lambda v: (votes[v], sums[v]))
            out.append(best)
            score[i] = of[i, k] * (sums[best] / (len(langs) - 1) if len(langs) > 1 else 1.0)
        return out, np.clip(score, 0.0, 1.0)


def train(docs: DataFrame, learn: Column, per_lang: int = PER_LANG, families: dict[str, str] = FAMILIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows where `learn` is true. Features are made on the executors; what comes to the driver is
    about per_lang vectors of 2 * BINS bytes for each language."""
    slim = docs.filter(learn).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("doc_id is not null and lang is not null and lang <> ''")
    counts = {r["lang"]: r["count"] for r in slim.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    span, per_lang = 1 << 20, max(1, min(per_lang, IN_ALL // len(counts)))
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(span, -(-per_lang * span // n)))])
    sample = slim.filter((F.pmod(F.xxhash64("doc_id"), F.lit(span)) < rate[F.col("lang")]) & F.col("text").isNotNull())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = [features(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("lang"), pa.array(vectors, pa.binary())], names=["doc_id", "lang", "x"])

    rows = sorted(map_blocks(sample, "text", run, "doc_id string, lang string, x binary").collect(), key=lambda r: (r["lang"], r["doc_id"], bytes(r["x"])))
    if not rows:
        return Model()
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in rows]).astype(np.float32)
    return Model.fit(x, [r["lang"] for r in rows], families)


def _told(docs: DataFrame, model: Model, text_col: str) -> Column:
    """A struct of lang_pred and score for each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        m = shared.value
        texts = column.to_pylist()
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        ask = [i for i, t in enumerate(texts) if t and m.families and LETTER.search(t)]
        for k in range(0, len(ask), 512):
            part = ask[k : k + 512]
            got, s = m.predict(np.stack([features(texts[i]) for i in part]))
            score[part] = s
            for i, g in zip(part, got):
                lang[i] = g
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    return text_udf(run, "lang_pred string, score double")(F.col(f"`{text_col}`").cast("string"))


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, from the text alone; columns of docs by these names give way."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0)).alias("row"), _told(docs, model, text_col).alias("told"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in names], "told.lang_pred", "told.score")


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language can be told."""
    return docs.filter(_told(docs, model, text_col)["lang_pred"] != "und")


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % parts == part, F.lit(False))


def report(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: held_out (crc32 of the id, modulo 4, is 2), lang_pred, score; learnt from the rows not held out."""
    model = train(docs, ~held_out(id_col), per_lang, FAMILIES, id_col, text_col, lang_col)
    slim = key_and_text(docs, id_col, text_col)
    return classify(slim, model).select(F.col("doc_id").alias(id_col), held_out("doc_id").alias("held_out"), "lang_pred", "score")
