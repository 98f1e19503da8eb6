"""Language identification by compression: the language whose zstandard dictionary encodes a text in the fewest bytes.

Each dictionary is raw content: lower-cased excerpts of a bounded sample of labelled documents (`per_lang` documents of
`excerpt` characters each, spread over each document). A language with little labelled text has a shorter dictionary and cuts
no other's. A text's words are cut into blocks, each is compressed with every dictionary, and sizes are added up, so that the
dictionaries stay in reach over long texts. Of equal sizes the dictionary that has most of the text's distinct words wins, then
the name. `accepted` is false where the margin to the second language is narrow. Null texts and texts without a letter: `und`,
score 0, not accepted. Very long texts are read whole, block by block. Repeated rows get the same answer; of labelled rows that
repeat a doc_id the least excerpt is learnt from. Extra columns are carried as they are. An empty table gives no rows; without
a labelled row every text is `und`.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findgrid.llm.common import appended

PER_LANG = 256
EXCERPT = 512
BLOCK = 600
LEVEL = 3
#: Least share of the best size by which the second must be larger.
MARGIN = 0.02
SHARPNESS = 60.0
_WORD = re.compile(r"[^\W\d_]+")


def learn(labelled: DataFrame, per_lang: int = PER_LANG, excerpt: int = EXCERPT) -> dict[str, bytes]:
    """Dictionary bytes by language from labelled rows (doc_id, text, lang): at most per_lang documents of a language,
    those with the least hash in each of per_lang slots, so the sample is bounded and spread over all rows."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND lang <> ''").select("lang", F.xxhash64("doc_id").alias("h"), "text")
    slot = F.pmod("h", F.lit(per_lang))
    picked = rows.groupBy("lang", slot.alias("s")).agg(F.min("h").alias("h")).select("lang", "h")
    n = F.length("text")
    # excerpts from three places of a document, never only its start
    parts = F.when(n <= excerpt, F.col("text")).otherwise(F.concat_ws("\n", *(F.substr("text", (F.lit(f) * (n - excerpt // 3)).cast("int") + 1, F.lit(excerpt // 3)) for f in (0.0, 0.5, 1.0))))
    got = rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min(parts).alias("t")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"])):
        out.setdefault(r["lang"], []).append(" ".join(_WORD.findall(r["t"].lower())))
    raw = {k: "\n".join(v).encode() for k, v in out.items()}
    return {k: v for k, v in raw.items() if v.strip()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` with lang_pred, score (0 to 1) and accepted. The dictionaries travel with the task: their size is
    bounded by languages * per_lang * excerpt."""
    names = sorted(dictionaries)

    def make():
        made = []
        for k in names:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        known: dict[str, set[str]] = {}

        def one(text: str | None) -> tuple[str, float, bool]:
            words = _WORD.findall(text.lower()) if text is not None and names else []
            if not any(c.isalpha() for w in words for c in w):
                return "und", 0.0, False
            blocks = [" ".join(words[i : i + BLOCK]).encode("utf-8", "replace") for i in range(0, len(words), BLOCK)]
            sizes = sorted((sum(len(c.compress(b)) for b in blocks), k) for c, k in zip(made, names, strict=True))
            if len(sizes) > 1 and sizes[0][0] == sizes[1][0]:
                if not known:
                    known.update({k: set(v.decode().split()) for k, v in dictionaries.items()})
                own = set(words)
                sizes.sort(key=lambda x: (x[0], -len(own & known[x[1]]), x[1]))
            if len(sizes) == 1:
                return sizes[0][1], 1.0, True
            margin = (sizes[1][0] - sizes[0][0]) / sizes[0][0]
            return sizes[0][1], 1 / (1 + math.exp(-min(SHARPNESS * margin, 50.0))), margin >= MARGIN

        return lambda texts: map(one, texts)

    return appended(docs, carry, "lang_pred string, score double, accepted boolean", {"lang_pred": pa.string(), "score": pa.float64(), "accepted": pa.bool_()}, make)
