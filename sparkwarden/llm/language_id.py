"""Language identification by nearest centroid, with rejection by distance.

A text becomes counts of its letter n-grams (one to three, lower case, everything between words a single blank), hashed with a
sign to ``DIMENSIONS`` places, weighed by TF-IDF and brought to length 1.  Signs let n-grams that share a place cancel out, so a long text
of no known language does not come near one by collisions alone: its cosine stays about 0.15 at any length, under the bound below.  Each language has several centroids, found by spherical
k-means, as its texts may form several clusters.  A text is of the language of the centroid of highest cosine.

Document frequencies are counted over all labelled rows.  Centroids are fitted on a bounded sample, ``SAMPLE`` rows per language in
a seeded hash order.  The model has languages x ``CENTROIDS`` x ``DIMENSIONS`` numbers, whatever the input, and is broadcast.

A text is rejected if it has no letter, or if it has at least ``ENOUGH`` letters and its cosine is under ``REJECT`` times
the lowest-percent cosine of its language's sample.  Null, empty and letterless texts are ``und`` with score 0; so is
everything when no labelled row exists (then only letterless texts are rejected).  Repeated rows get equal results; ties go to the language first by name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.llm.bpe import LETTER, _classes
from sparkwarden.llm.common import Scratch, chunks, widened

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE = 1500
ENOUGH = 100
REJECT = 0.4
ROWS = 128
UNKNOWN_LANGUAGE = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Signed counts (texts x DIMENSIONS) of hashed letter n-grams, and each text's number of letters."""
    lowered = [(t or "").lower() for t in texts]
    lengths = np.array([len(t) + 1 for t in lowered], dtype=np.int64)
    points = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le"), np.uint32)
    letter = _classes()[points] == LETTER
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    letters = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    symbols, owner = np.where(letter, points, np.uint32(32))[keep], owner[keep]
    out = np.zeros(len(texts) * DIMENSIONS, np.float32)
    rolled = np.zeros(len(symbols), np.uint32)
    for k in range(3):
        n = len(symbols) - k
        if n <= 0:
            break
        rolled = rolled[:n] + symbols[k:] * _FACTORS[k]
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(k)
        inside = owner[:n] == owner[k:]
        sign = np.where((mixed >> np.uint32(19)) & np.uint32(1), np.float32(1), np.float32(-1))[inside]
        out += np.bincount((owner[:n] * DIMENSIONS + (mixed >> np.uint32(20)))[inside], sign, len(out)).astype(np.float32)
    return out.reshape(len(texts), DIMENSIONS), letters


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sign(counts) * np.log1p(np.abs(counts)) * idf
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def _pieces(batches, text: str):
    for whole in batches:
        for part in chunks(whole, text):
            for at in range(0, len(part), ROWS):
                yield part.slice(at, ROWS)


def _frequencies(docs: DataFrame) -> DataFrame:
    """(place, df) over all rows of ``docs``; place -1 counts the rows."""
    def run(batches):
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for b in _pieces(batches, "__text"):
            counts, _ = gram_counts(b.column("__text").to_pylist())
            df += (counts != 0).sum(axis=0)
            n += len(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate(([n], df)))], ["place", "df"])

    return docs.select("__text").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))


def _clusters(x: np.ndarray) -> np.ndarray:
    """Spherical k-means, started from the mean's farthest rows; the order of rows decides ties."""
    centers = [x.mean(axis=0)]
    while len(centers) < min(CENTROIDS, len(x)):
        near = np.max(x @ np.stack([c / max(np.linalg.norm(c), 1e-9) for c in centers]).T, axis=1)
        centers.append(x[near.argmin()])
    c = np.stack(centers)
    for _ in range(12):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        mine = (x @ c.T).argmax(axis=1)
        c = np.stack([x[mine == k].mean(axis=0) if (mine == k).any() else c[k] for k in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(labelled: DataFrame) -> dict:
    """Model from ``labelled`` (__id, __text, __lang): idf, centroids, their languages and rejection bounds."""
    scratch = Scratch(labelled.sparkSession)
    freq = _frequencies(labelled).toArrow().to_pandas().set_index("place")["df"]
    n = int(freq.get(-1, 0))
    idf = np.log((n + 1) / (freq.reindex(range(DIMENSIONS), fill_value=0).to_numpy() + 1)).astype(np.float32) + np.float32(1)
    # a hash threshold leaves about twice the sample per language, whatever its size; the exact cut follows on these rows
    full = labelled.where(F.length(F.trim("__text")) > 0).withColumn("hash", F.xxhash64(F.lit(9), "__id"))
    sizes = full.groupBy("__lang").agg(F.count(F.lit(1)).alias("size"))  # one row per language
    near = full.join(F.broadcast(sizes), "__lang").where(F.pmod("hash", F.lit(1 << 30)) < (1 << 31) * SAMPLE / F.col("size"))
    turn = Window.partitionBy("__lang").orderBy("hash", "__id")
    chosen = near.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= SAMPLE)

    def vectors(batches):
        for b in _pieces(batches, "__text"):
            v = _weigh(gram_counts(b.column("__text").to_pylist())[0], idf)
            yield pa.RecordBatch.from_arrays([b.column("__lang"), b.column("rank"), pa.array(list(v), pa.list_(pa.float32()))], ["lang", "rank", "v"])

    sample = chosen.repartition("__lang", "rank").select("__lang", "rank", "__text").mapInArrow(vectors, "lang string, rank int, v array<float>")

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("rank")["v"].to_numpy())
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "low": [], "v": []})
        c = _clusters(x)
        low = float(np.quantile((x @ c.T).max(axis=1), 0.01))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "low": low, "v": list(c)})

    model = scratch.save(sample.groupBy("lang").applyInPandas(centre, "lang string, low double, v array<float>"), "model").toPandas()
    model["first"] = [tuple(v[:8]) for v in model["v"]]
    model = model.sort_values(["lang", "first"])
    return {"idf": idf, "langs": model["lang"].tolist(), "low": model["low"].to_numpy(float), "centroids": np.stack(model["v"].to_numpy()) if len(model) else np.zeros((0, DIMENSIONS), np.float32)}


def identify(df: DataFrame, learn_from: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of ``df`` and ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``; ``learn_from`` has id, text and lang."""
    labelled = learn_from.where(F.col(lang).isNotNull()).select(F.col(id_column).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    shared = df.sparkSession.sparkContext.broadcast(fit(labelled))
    out = df.drop("lang_pred", "score", "rejected")
    fields = out.columns

    def run(batches):
        m = shared.value
        langs = np.array([*m["langs"], UNKNOWN_LANGUAGE], dtype=object)
        for b in _pieces(batches, text):
            counts, letters = gram_counts(b.column(text).to_pylist())
            if len(m["langs"]):
                cosine = _weigh(counts, m["idf"]) @ m["centroids"].T
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)
                far = (letters >= ENOUGH) & (score < REJECT * m["low"][best])
            else:
                best, score, far = np.full(len(b), -1), np.zeros(len(b)), np.zeros(len(b), bool)
            none = letters == 0
            best = np.where(none, -1, best)
            score[none] = 0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), pa.array(langs[best].tolist(), pa.string()), pa.array(score), pa.array(far | none)], [*fields, "lang_pred", "score", "rejected"])

    return out.mapInArrow(run, widened(out, lang_pred="string", score="double", rejected="boolean"))
