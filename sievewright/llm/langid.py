"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.scratch import bounded_sample, crc_part, materialize, small_or_joined
from sievewright.llm.texts import U, mix, slices

ORDER = 4
#: Most n-grams that a language's table of one order holds, the most frequent ones; a rank of counts that would pass it is left out whole.
GRAMS = 200_000
#: One in so many training rows is not counted but calibrates, of languages with so many rows at least.
CALIBRATED, ENOUGH = 10, 50
#: Bounds of the sample of rows on which confidence is calibrated; least confidence that is not a rejection.
SAMPLE_ROWS, SAMPLE_BYTES, LEAST_CONFIDENCE = 5_000, 16 << 20, 0.5
UNDETERMINED = "und"
_BLANK = 32
#: Code points take 21 bits: three of them are one 64-bit number, a 4-gram is such a number and its last code point.
_POINT = 21
_MUL = np.random.default_rng(4099).integers(1, 1 << 63, ORDER, dtype=np.uint64) * U(2) + U(1)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, runs of non-letters as one blank, each text led by ``ORDER - 1`` blanks.

    Returns the symbols, the position of every real symbol, and the text that it belongs to.
    """
    texts = [(t or "").lower() for t in column.to_pylist()]
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), size)
    letter = _letters()[code]
    keep = letter | np.r_[False, letter[:-1] & (doc[1:] == doc[:-1])] if len(code) else letter
    kept, doc = np.where(letter, code, _BLANK)[keep], doc[keep]
    at = np.arange(len(kept)) + (ORDER - 1) * (doc + 1)
    out = np.full(len(kept) + (ORDER - 1) * len(texts), _BLANK, np.uint32)
    out[at] = kept
    return out, at, doc


def gram_hash(codes: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(codes[0]), len(codes), np.uint64)
    for m, c in zip(_MUL, codes):
        h = h + c.astype(np.uint64) * m
    return mix(h)


def _windows(out: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [out[at - k] for k in range(ORDER - 1, -1, -1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the 4-grams of a slice of texts by language; Spark adds them up."""
    for batch in slices(batches, "text"):
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs])
        out, at, doc = symbols(batch.column("text"))
        if not len(at):
            continue
        grams = _windows(out, at)
        key = gram_hash(grams) ^ mix(number[doc].astype(np.uint64))
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        a, b, c, last = (g[first].astype(np.int64) for g in grams)
        lang = pa.array(names, pa.string()).take(pa.array(number[doc[first]]))
        yield pa.RecordBatch.from_arrays([lang, pa.array((a << (2 * _POINT)) | (b << _POINT) | c), pa.array(last), pa.array(count)], ["lang", "head", "last", "c"])


def _codes(head: np.ndarray, last: np.ndarray, n: int) -> list[np.ndarray]:
    """Code points of n-grams whose first ``n - 1`` are one number."""
    return [(head >> (_POINT * (n - 2 - k))) & ((1 << _POINT) - 1) for k in range(n - 1)] + [last]


def _rank(c: Column) -> Column:
    """Counts below 65,536 as they are, larger ones by steps of their logarithm: 131,072 ranks at most, in order."""
    return F.when(c < 65_536, c).otherwise(F.floor(F.log2(c) * 1_024).cast("long") + 65_536 - 16 * 1_024)


def _cutoffs(counts: DataFrame, most: int) -> dict[str, tuple[int, float, int]]:
    """By language: the least rank that a table keeps, the discount of Kneser and Ney, and the number of n-grams.

    From counts of ranks, which are few however many n-grams there are. A rank is kept or left out whole; where not even the highest one fits, none is kept.
    """
    ranks: dict[str, dict[int, int]] = {}
    for lang, rank, n in counts.groupBy("lang", _rank(F.col("c")).alias("rank")).agg(F.count("*").alias("n")).collect():
        ranks.setdefault(lang, {})[rank] = n
    out = {}
    for lang, by_rank in ranks.items():
        kept, least = 0, 1 << 62
        for rank in sorted(by_rank, reverse=True):
            if kept + by_rank[rank] > most:
                break
            kept, least = kept + by_rank[rank], rank
        n1, n2 = by_rank.get(1, 0) + 0.5, by_rank.get(2, 0)
        out[lang] = (least, n1 / (n1 + 2 * n2 + 0.5), sum(by_rank.values()))
    return out


def train(docs: DataFrame, most: int = GRAMS) -> dict:
    """``docs(text, lang)`` -> the model: per language, for each order, log probabilities and back-off weights in sorted hash arrays.

    Spark counts all 4-grams of all training texts; lower orders count distinct left neighbours (Kneser-Ney). Each
    order keeps its ``most`` most frequent n-grams a language; they are discounted by ``n1 / (n1 + 2 n2)`` of the full counts, what they
    leave of a context goes to the next lower order, so that probabilities sum to one whatever was left out.
    """
    four = materialize(docs.select("text", "lang").mapInArrow(_count, "lang string, head bigint, last bigint, c bigint").groupBy("lang", "head", "last").agg(F.sum("c").alias("c")))
    tables = {ORDER: four}
    for n in range(ORDER - 1, 0, -1):
        # the n-gram without its first code point
        head = F.col("head").bitwiseAND(F.lit((1 << (_POINT * (n - 1))) - 1)) if n > 1 else F.lit(0).cast("long")
        tables[n] = materialize(tables[n + 1].select("lang", head.alias("head"), "last").groupBy("lang", "head", "last").agg(F.count("*").alias("c")))
    model: dict = {}
    for n in range(1, ORDER + 1):
        known = _cutoffs(tables[n], most)
        if not known:
            return {}
        for lang, (_, _, types) in known.items() if n == 1 else ():
            model[lang] = {"u": (np.zeros(1, np.uint64), np.log(np.ones(1) / (types + 1)))}  # where no symbol is kept
        least = docs.sparkSession.createDataFrame([(k, v[0]) for k, v in known.items()], "lang string, least long")
        kept = tables[n].join(least, "lang").where(_rank(F.col("c")) >= F.col("least")).drop("least")
        totals = tables[n].groupBy("lang", "head").agg(F.sum("c").alias("total"))
        rows = kept.join(totals, ["lang", "head"]).toPandas()  # `most` rows a language at most
        for lang, own in rows.groupby("lang"):
            mine = model[lang]
            _, discount, types = known[lang]
            head, last, c, total = (own[k].to_numpy() for k in ("head", "last", "c", "total"))
            seen = np.maximum(c - discount, 0.0) / total
            heads, at = np.unique(head, return_inverse=True)
            rest = np.maximum(1.0 - np.bincount(at, seen), 1e-12)
            codes = _codes(head, last, n)
            if n == 1:
                # below single symbols: all symbols of the language and one unknown alike
                p, mine["u"] = seen + rest[at] / (types + 1), (np.zeros(1, np.uint64), np.log(rest / (types + 1)))
            else:
                below = log_probability(mine, codes[1:])
                p = seen + rest[at] * np.exp(below)
                context = gram_hash(_codes(heads >> _POINT, heads & ((1 << _POINT) - 1), n - 1))
                order = np.argsort(context)
                mine[f"b{n - 1}"] = context[order], np.log(rest)[order]
            key = gram_hash(codes)
            order = np.argsort(key)
            mine[f"p{n}"] = key[order], np.log(p)[order]
    return model


def _find(table: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if table is None or not len(table[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[0][at] == keys, table[1][at]


def log_probability(model: dict, grams: list[np.ndarray]) -> np.ndarray:
    """Log probability of each n-gram's last symbol in one language, backing off from order to order."""
    n, longest = len(grams[0]), len(grams)
    out, open_, passed = np.zeros(n), np.ones(n, bool), np.zeros(n)
    for order in range(longest, 0, -1):
        there, p = _find(model.get(f"p{order}"), gram_hash(grams[longest - order :]))
        new = open_ & there
        out[new] = passed[new] + p[new]
        open_ &= ~there
        if order > 1:
            there, b = _find(model.get(f"b{order - 1}"), gram_hash(grams[longest - order : -1]))
            passed += np.where(there, b, 0.0)
    out[open_] = passed[open_] + model["u"][1][0]
    return out


def entropies(model: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy (nats a symbol) of each text in each language, and the number of symbols."""
    out, at, doc = symbols(column)
    n = len(column)
    size = np.bincount(doc, minlength=n)
    if not len(at) or not model:
        return np.zeros((n, len(model))), size
    grams = _windows(out, at)
    _, first, inverse = np.unique(gram_hash(grams), return_index=True, return_inverse=True)
    grams = [g[first] for g in grams]
    total = [np.bincount(doc, log_probability(model[k], grams)[inverse], n) for k in sorted(model)]
    return -np.stack(total, 1) / np.maximum(size, 1)[:, None], size


def _judged(model: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, size = entropies(model, column)
    if not h.shape[1]:
        return np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
    best = h.argmin(1)
    two = np.sort(h, 1)[:, :2]
    margin = (two[:, 1] - two[:, 0] if h.shape[1] > 1 else np.ones(len(best))) * np.sqrt(np.maximum(size, 1))
    return best, margin, two[:, 0], size


def calibrate(docs: DataFrame, model: dict) -> dict:
    """Share of right predictions by margin, rising, and the cross-entropy that few texts pass, from a bounded sample of rows that were not counted."""
    names = sorted(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            best, margin, h, size = _judged(shared.value, batch.column("text"))
            right = np.array([names[b] == x for b, x in zip(best.tolist(), batch.column("lang").to_pylist())])
            some = size > 0
            yield pa.RecordBatch.from_arrays([pa.array(margin[some]), pa.array(h[some]), pa.array(right[some])], ["margin", "h", "correct"])

    got = bounded_sample(docs, SAMPLE_ROWS, SAMPLE_BYTES).select("text", "lang").mapInArrow(run, "margin double, h double, correct boolean").toPandas().sort_values("margin", kind="stable")
    if got.empty:
        return {"margin": np.array([0.0, 1.0]), "confidence": np.array([0.5, 0.99]), "most": np.inf}
    # groups of thirty rows or more; those that fall are pooled with the one before, so that confidence rises with the margin
    pools: list[list[float]] = []
    for g in np.array_split(np.arange(len(got)), max(1, min(20, len(got) // 30))):
        pools.append([got["margin"].to_numpy()[g].sum(), got["correct"].to_numpy()[g].sum(), len(g)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    edge = np.array([margin / n for margin, _, n in pools])
    share = np.array([(right + 1) / (n + 1.02) for _, right, n in pools])
    return {"margin": np.r_[0.0, edge], "confidence": np.r_[min(0.5, share[0]), share], "most": float(np.quantile(got["h"], 0.999) * 1.5)}


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every document; learned from rows whose crc32 modulo ``folds`` is not ``held``.

    ``lang_pred`` is the language of the lowest cross-entropy a symbol; ``score`` the calibrated chance that it is
    right; ``rejected`` tells that the score is below a half or that the text fits no learned language.

    Counts cover all training rows but every tenth, which calibrates.

    Defined cases: null texts and texts without letters are ``und`` with score 0, rejected; rows without ``lang`` are never
    learned from; ties go to the first language by name; one learned language alone has a margin of one; a null ``doc_id`` is held
    out; without training rows all is ``und``; languages are few (hundreds); extra columns, whatever their names, are ignored.
    """
    known = docs.select("doc_id", "text", "lang").where((crc_part(folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # languages with few rows are counted whole
    many = known.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= ENOUGH).select(F.col("lang").alias("_many"))
    many = small_or_joined(materialize(many))  # a row a language: texts stay where they are
    tested = F.col("_many").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATED)) == 0)
    split = known.join(many, F.col("lang") == F.col("_many"), "left").withColumn("_tested", tested)
    model = train(split.where("not _tested"))
    calibrating = split.where("_tested").select("doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast((model, calibrate(calibrating, model)))
    names = [*sorted(model), UNDETERMINED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scale = shared.value
        for batch in slices(batches, "text"):
            best, margin, h, size = _judged(own, batch.column("text"))
            none = (size == 0) | (not own)
            p = np.where(none, 0.0, np.interp(margin, scale["margin"], scale["confidence"]))
            rejected = none | (p < LEAST_CONFIDENCE) | (h > scale["most"])
            lang = [names[b] for b in np.where(none, len(names) - 1, best).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(p), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held_out = F.coalesce(crc_part(folds) == held, F.lit(True)).alias("held_out")
    return docs.select("doc_id", "text", held_out).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
