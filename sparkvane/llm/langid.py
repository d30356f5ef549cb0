"""Language ID by language-bitmask n-gram filters.

Training counts letter trigrams (with word edges) per language over all
labelled texts of the training folds. A language contains a trigram that makes
up at least SHARE of its trigrams, whatever other languages do; so it has at
most 1 / SHARE, which, with at most LANGUAGES languages, bounds what is
broadcast. A bit-sliced Bloom filter holds, at each of its positions, a mask
with one bit per language: ANDing the masks at an n-gram's positions gives all
languages that contain it. Per language the set bits are counted over the text,
corrected for the filter's false positives; the largest count decides.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fold, is_fold, read, slices, small_batches

SHARE = 3e-4
LANGUAGES = 1024
REJECT = 0.1  # a text goes whose best language contains a smaller part of its trigrams, by more than
MARGIN, ENOUGH = 0.02, 30_000  # MARGIN if the least known language was learned from ENOUGH trigrams
HASHES, BITS_PER_GRAM = 4, 16
_EDGE = 0x20


@lru_cache(1)
def _letters():
    import numpy as np

    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Grams:
    """The trigrams of a run of texts: `keys[code]` names trigram `code`; per position
    `codes`, and `doc` where each text's positions begin (in `codes`)."""

    def __init__(self, texts: list[str | None]) -> None:
        import numpy as np

        joined = "\n" + "\n".join(t.lower() if t else "" for t in texts) + "\n"
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(t.lower()) if t else 0 for t in texts), np.int64, len(texts))
        edge = ~_letters()[raw]
        self.has_letter = np.zeros(len(texts), bool)
        begin = 1 + np.concatenate(([0], np.cumsum(sizes + 1)))  # of each text in `joined`
        clean = np.where(edge, _EDGE, raw)
        present = np.zeros(0x110000, bool)
        present[clean] = True
        symbols = np.flatnonzero(present)
        lut = np.zeros(0x110000, np.uint32)
        lut[symbols] = np.arange(len(symbols))
        bits = max(1, int(len(symbols) - 1).bit_length())
        c = lut[clean]
        mid = np.flatnonzero(~edge[1:-1]) + 1
        first = np.searchsorted(mid, begin)
        self.doc = first[:-1]
        self.count = np.diff(first)
        self.has_letter = self.count > 0
        if 3 * bits <= 22:
            code = (c[mid - 1] << np.uint32(2 * bits)) | (c[mid] << np.uint32(bits)) | c[mid + 1]
            seen = np.zeros(1 << (3 * bits), bool)
            seen[code] = True
            distinct = np.flatnonzero(seen)
            place = np.zeros(1 << (3 * bits), np.int32)
            place[distinct] = np.arange(len(distinct))
            self.codes = place[code]
        else:
            wide = (c[mid - 1].astype(np.int64) << (2 * bits)) | (c[mid].astype(np.int64) << bits) | c[mid + 1]
            distinct, self.codes = np.unique(wide, return_inverse=True)
        low = (1 << bits) - 1
        part = [symbols[(distinct >> (bits * k)) & low].astype(np.int64) for k in (2, 1, 0)]
        self.keys = part[0] << 42 | part[1] << 21 | part[2]


def _count_grams(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for b in slices(batch, 1 << 20):
            langs = b.column("lang").to_pylist()
            g = Grams(b.column("text").to_pylist())
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            who = np.repeat(np.array([number[x] for x in langs], np.int64), g.count)
            n = len(g.keys)
            if not n:
                continue
            counts = np.bincount(who * n + g.codes, minlength=n * len(names)) if len(g.codes) else np.zeros(n, np.int64)
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in (hit // n).tolist()], pa.string()), pa.array(g.keys[hit % n]), pa.array(counts[hit].astype(np.int64))], ["lang", "gram", "n"])


def _train(docs: DataFrame, share: float = SHARE, lang_col="lang", text_col="text"):
    """train(), and the trigrams of the language that has the fewest."""
    d = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = durable(d.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    of = totals.orderBy("lang").limit(LANGUAGES + 1).collect()
    langs = [r.lang for r in of]
    if len(langs) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    number = {x: i for i, x in enumerate(langs)}
    rows = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= share * F.col("total")).select("lang", "gram").collect()  # at most 1 / share a language
    return langs, [(number[r.lang], r.gram) for r in rows], min((r.total for r in of), default=0)


def train(docs: DataFrame, share: float = SHARE, lang_col="lang", text_col="text"):
    """(languages, [(number of the language, gram)]) from rows with a language and a text;
    rows that lack either are ignored. Over LANGUAGES languages are refused."""
    return _train(docs, share, lang_col, text_col)[:2]


class BitSlicedFilter:
    """One mask word per position (several for over 64 languages)."""

    def __init__(self, langs: list[str], grams: list[tuple[int, int]], learned: int = 0) -> None:
        import numpy as np

        self.learned = learned
        self.langs = langs
        of: list[list[int]] = [[] for _ in langs]
        for i, g in grams:
            of[i].append(g)
        self.size = 1 << int(max([1, *map(len, of)]) * BITS_PER_GRAM - 1).bit_length()
        self.words = np.zeros((max(1, -(-len(langs) // 64)), self.size), np.uint64)
        for i, keys in enumerate(of):
            for at in self._places(np.array(keys, np.int64)):
                self.words[i // 64, at] |= np.uint64(1 << (i % 64))
        fill = [float(((self.words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))]
        self.false = [f**HASHES for f in fill]

    def _places(self, keys):
        import numpy as np

        x = keys.astype(np.uint64)
        for k in range(HASHES):
            h = (x ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            yield (h >> np.uint64(20)) & np.uint64(self.size - 1)

    def masks(self, keys):
        """Per word: for each n-gram the languages that contain it."""
        import numpy as np

        out = np.full((len(self.words), len(keys)), ~np.uint64(0))
        for at in self._places(keys):
            out &= self.words[:, at]
        return out

    def classify(self, g: Grams) -> tuple[list[str], list[float]]:
        import numpy as np

        n = len(g.count)
        best = np.full(n, -1.0)
        who = np.zeros(n, np.int64)
        if len(g.codes):
            masks = self.masks(g.keys)
            ends = np.concatenate((g.doc, [len(g.codes)]))
            for i in range(len(self.langs)):
                bit = ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
                run = np.concatenate(([0], np.cumsum(bit[g.codes])))
                hits = run[ends[1:]] - run[ends[:-1]]
                f = self.false[i]
                true = np.maximum(0, (hits - f * g.count) / (1 - f) if f < 1 else 0 * hits)
                who = np.where(true > best, i, who)
                best = np.maximum(best, true)
        lang = [self.langs[w] if ok and self.langs else "und" for w, ok in zip(who.tolist(), g.has_letter.tolist())]
        score = np.where(g.has_letter & bool(self.langs), np.maximum(best, 0) / np.maximum(1, g.count), 0.0)
        return lang, np.minimum(1.0, score).tolist()


def _predict(bc):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, 1 << 20):
                lang, score = bc.value.classify(Grams(b.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(c for n, c in zip(b.schema.names, b.columns) if n != "text"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*(n for n in b.schema.names if n != "text"), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: BitSlicedFilter, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score, one row per input row. A text that is null or has no
    letter is `und` with score 0, as is any text under a model without languages;
    ties go to the language of first name; other columns are ignored."""
    d = fold(docs, id_col, text_col)
    bc = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(_predict(bc), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def least_share(learned: int, reject: float = REJECT) -> float:
    """The share of its trigrams under which a text is in none of the languages.

    What a language's set holds of it is an estimate from the trigrams learned. By
    Hoeffding's inequality it is off by over MARGIN * sqrt(ENOUGH / learned) with a
    chance of exp(-2 * ENOUGH * MARGIN ** 2), 4e-11, whatever `learned` is; a share
    within that of `reject` may belong to a language. Under 0: no text goes."""
    return reject - MARGIN * (ENOUGH / learned) ** 0.5 if learned else 0.0


def keep_known(docs: DataFrame, model: BitSlicedFilter, text_col: str = "text", lang_col: str = "lang", reject: float = REJECT) -> DataFrame:
    """`docs` without the rows whose text is null, has no letter or scores under `reject` by more
    than can be chance (`least_share`); all columns and other rows stay as they are, but a null
    `lang_col` (if there is one, of strings) becomes the predicted language. A model without
    languages rejects only texts without a letter."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    least = least_share(model.learned, reject)
    fill = lang_col in docs.columns and dict(docs.dtypes)[lang_col] == "string" and bool(model.langs)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for b in slices(batch, 1 << 20, text_col):
                grams = Grams(b.column(at).to_pylist())
                lang, score = bc.value.classify(grams)
                ok = [bool(has) and s >= least for has, s in zip(grams.has_letter, score)]
                if fill:
                    k = b.schema.get_field_index(lang_col)
                    b = b.set_column(k, b.schema.field(k), pc.coalesce(b.column(k), pa.array(lang, b.column(k).type)))
                yield b.filter(pa.array(ok, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def trained_filter(docs: DataFrame, id_col="doc_id") -> BitSlicedFilter:
    return BitSlicedFilter(*_train(docs.where(~is_fold(id_col, 3))))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs, trained_filter(docs))
    return out.select("doc_id", is_fold("doc_id", 3).alias("held_out"), "lang_pred", "score")
