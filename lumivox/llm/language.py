"""Operator 4: language identification by compression with per-language dictionaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.llm.storage import slices

UNKNOWN = "und"
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def plain(text: str | None) -> str:
    """A text's letters and their marks in lower case, with single spaces where anything else stood; empty if it has no letter (marks alone are none)."""
    return _OTHER.sub(" ", text.lower()).strip() if text and _LETTER.search(text) else ""


def _spread(text: str, size: int, parts: int = 3) -> str:
    """About ``size`` letters of a text in ``parts`` pieces from begin to end, the whole text where it is shorter."""
    if len(text) <= size:
        return text
    each = max(1, size // parts)
    return " ".join(text[(len(text) - each) * i // max(1, parts - 1) :][:each] for i in range(parts))


def learn_dictionaries(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", size: int = 65536, texts: int = 400) -> dict[str, bytes]:
    """A raw-content dictionary of ``size`` bytes for each language, from about ``texts`` of its texts.

    Rows without a language or text teach nothing. The texts are those with the lowest hashes, so their choice
    follows no order of the table, and each gives an equal part of the dictionary, in pieces from its begin to its
    end, so no long text fills it and none is read in part. Both bounds are parameters; what the driver gathers is
    ``size`` bytes a language. There are as many dictionaries as languages, the most frequent language first.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, texts / n) * (1 << 30)))])
    chosen = known.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).alias("text"), (F.lit(size) / F.least(F.lit(texts), F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col(lang_col)])).cast("int").alias("each"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [_spread(plain(t), n) for t, n in zip(batch.column("text").to_pylist(), batch.column("each").to_pylist())]
            yield pa.record_batch([batch.column("lang"), batch.column("draw"), pa.array(pieces, pa.string())], names=["lang", "draw", "piece"])

    sample: dict[str, list[str]] = {}
    for r in chosen.mapInArrow(take, f"lang {known.schema[lang_col].dataType.simpleString()}, draw long, piece string").orderBy("draw", "piece").collect():
        sample.setdefault(r["lang"], []).append(r["piece"])
    learned = {}
    for lang, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        content = " ".join(sample.get(lang, [])).encode()[:size]
        if content:
            learned[lang] = content
    return learned


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = 6, margin: float = 0.02, reject: bool = True) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``narrow`` to the rows: the language whose dictionary leaves the whole text smallest.

    The gap is what the smallest size saves of the second smallest: ``score`` is 0.5 at a tie and nears 1 as the gap
    widens (0 for ``und``). A gap below ``margin`` is ``narrow``: such a text is rejected, its verdict ``und``, unless
    ``reject`` is unset. Null texts and texts without a letter are ``und`` and not narrow. Ties go to the first of
    ``dictionaries``; with none at all every row is ``und``. Whole texts are compressed, however long; repeated rows have
    one verdict each; an empty table gives an empty one; columns that have one of the three names are replaced, the
    others pass through unchanged.
    """
    names = list(dictionaries)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "narrow")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = []
        for name in names:
            held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            compressors.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False))

        def verdict(text: str | None) -> tuple[str, float, bool]:
            content = plain(text).encode()
            if not content or not names:
                return UNKNOWN, 0.0, False
            sizes = sorted((len(c.compress(content)), i) for i, c in enumerate(compressors))
            if len(sizes) == 1:
                return names[0], 1.0, False
            gap = 1 - sizes[0][0] / sizes[1][0]
            narrow = gap < margin
            return (UNKNOWN, 0.0, True) if narrow and reject else (names[sizes[0][1]], 1 / (1 + math.exp(-40 * gap)), narrow)

        for batch in slices(batches, text_col, 4 << 20):
            found = list(zip(*[verdict(t) for t in batch.column(text_col).to_pylist()]))
            columns = [pa.array(v, kind) for v, kind in zip(found, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score", "narrow"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(scan, f"{fields}, lang_pred string, score double, narrow boolean")
