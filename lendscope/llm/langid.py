"""Language identification by compression.

For every language a zstandard raw-content dictionary is cut from a bounded
sample of its texts; a text is encoded with each dictionary and the language
with the smallest output wins.  The text is encoded in segments of
``SEGMENT`` bytes, each on its own, so the dictionary helps in all parts of a
long text; all segments of the whole text are encoded.  A decision whose
margin (second smallest over smallest, less one) is under ``min_margin`` is
marked as not accepted.

Defined results: ``und`` (score 0, not accepted) for a null text and a text
without any letter, and for every text when no language could be learnt.
Equal sizes go to the alphabetically first language.  Repeated rows get equal
results.  Only ``text`` is read for a prediction; ``doc_id`` and ``lang`` only
choose and label the sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import map_texts

SEGMENT = 1024
LEVEL = 6
LONG_WORD, PIECE = 256, 16


def fit(docs: DataFrame, train, dictionary_bytes: int = 64 * 1024, per_language: int = 200,
        max_languages: int = 400, seed: int = 3) -> dict[str, bytes]:
    """Dictionaries by language, from about ``per_language`` documents of each
    (those whose id fulfils ``train`` and whose lang isn't null; a seeded hash
    of the id decides).  A document
    gives at most its first ``dictionary_bytes`` characters to a dictionary,
    as no more fits in.  Beyond ``max_languages`` values of lang this raises
    an error rather than leave one out."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()
    if len(size) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    if not size:
        return {}
    space = 1 << 30
    shares = F.create_map(*[x for r in size for x in (F.lit(r["lang"]), F.lit(min(space, space * per_language // r["n"])))])
    taken = (rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(space)) < shares[F.col("lang")])
             .groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, dictionary_bytes)).alias("text")))
    by: dict[str, list] = {}
    for r in taken.collect():
        by.setdefault(r["lang"], []).append((r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    # zstandard takes raw content of 8 bytes or more; every language stays
    made = {k: raw_content([t for *_, t in sorted(by[k])], dictionary_bytes) for k in sorted(by)}
    return {k: v if len(v) >= 8 else v * 8 for k, v in made.items()}


def raw_content(texts: list[str], dictionary_bytes: int) -> bytes:
    """The words of the sample, lower-cased, each once, the most frequent ones
    last (nearest to the text, where zstandard codes them shortest), cut at
    ``dictionary_bytes``.  Single words rather than running text: a passage
    that a sampled document shares with texts of another language can't match
    as a whole.  Words of over ``LONG_WORD`` characters (languages that write
    no spaces) are cut into pieces of ``PIECE``."""
    count: dict[str, int] = {}
    for t in texts:
        for word in t.lower().split():
            for w in [word] if len(word) <= LONG_WORD else [word[i:i + PIECE] for i in range(0, len(word), PIECE)]:
                count[w] = count.get(w, 0) + 1
    out, size = [], 0
    for w in sorted(count, key=lambda w: (-count[w], w)):
        b = w.encode("utf-8", "replace") + b" "
        if size + len(b) > dictionary_bytes:
            break
        out.append(b)
        size += len(b)
    return b"".join(reversed(out))


def compressed_sizes(compressors: list, view) -> np.ndarray:
    total = np.zeros(len(compressors))
    for lo in range(0, max(len(view), 1), SEGMENT):
        part = view[lo:lo + SEGMENT]
        for j, c in enumerate(compressors):
            total[j] += len(c.compress(part))
    return total


def _compressors(dictionaries: dict[str, bytes]):
    import zstandard as z

    out = []
    for data in dictionaries.values():
        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.02,
            carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) with lang_pred, score
    (margin / (margin + min_margin), so 0.5 is the limit of acceptance; with
    one language only: 1) and accepted."""
    langs = list(dictionaries)
    made: list = []

    def run(views, batch):
        import regex

        letter = regex.compile(r"\p{L}")
        if not made:
            made.extend(_compressors(dictionaries))
        pred, score = [], []
        for v in views:
            text = bytes(v).decode("utf-8", "replace").lower()
            if not langs or letter.search(text) is None:
                pred.append("und")
                score.append(0.0)
                continue
            size = compressed_sizes(made, text.encode())
            order = np.argsort(size, kind="stable")
            pred.append(langs[order[0]])
            margin = size[order[1]] / size[order[0]] - 1 if len(langs) > 1 else np.inf
            score.append(1.0 if np.isinf(margin) else float(margin / (margin + min_margin)))
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([s >= 0.5 for s in score])]

    return map_texts(docs, run, "lang_pred string, score double, accepted boolean", [], carry)
