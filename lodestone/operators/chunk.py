"""Sentence-aware chunks with overlap: one projection over pages, no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import sentences, word_count
from lodestone.sources.shared import numbered

CHUNK_WORDS, OVERLAP_WORDS = 200, 30


def ranges(widths: str, chunk_words: int, overlap_words: int) -> Column:
    """(lo, hi) sentence ranges of the chunks, from the sentences' word counts.

    A fold over the sentences that carries where the open chunk begins and how many
    words it has. A chunk is closed when the next sentence would pass chunk_words; the
    longest run of its last sentences within overlap_words opens the next.
    """
    return F.expr(f"""
      aggregate(
        sequence(0, size({widths}) - 1),
        named_struct('lo', 0, 'words', 0, 'out', cast(array() AS array<struct<lo: int, hi: int>>)),
        (a, i) -> CASE WHEN a.words + {widths}[i] > {chunk_words} AND i > a.lo THEN
          transform(
            array(aggregate(
              sequence(1, least({max(1, overlap_words)}, i - a.lo)),
              named_struct('n', 0, 'words', 0, 'open', true),
              (b, k) -> CASE WHEN b.open AND b.words + {widths}[i - k] <= {overlap_words}
                THEN named_struct('n', b.n + 1, 'words', b.words + {widths}[i - k], 'open', true)
                ELSE named_struct('n', b.n, 'words', b.words, 'open', false) END
            )),
            c -> named_struct('lo', i - c.n, 'words', c.words + {widths}[i], 'out', array_append(a.out, named_struct('lo', a.lo, 'hi', i - 1)))
          )[0]
        ELSE named_struct('lo', a.lo, 'words', a.words + {widths}[i], 'out', a.out) END,
        a -> array_append(a.out, named_struct('lo', a.lo, 'hi', size({widths}) - 1))
      )""")


def chunk_pages(pages: DataFrame, chunk_words: int = CHUNK_WORDS, overlap_words: int = OVERLAP_WORDS) -> DataFrame:
    """(source, page, text) -> (source, page, chunk_no, text, n_words, first_sentence, last_sentence)."""
    # no filter on the sentences: pushed down, it would split every page a second time
    split = pages.select("source", "page", sentences(F.col("text")).alias("s"))
    counted = split.withColumn("w", F.transform("s", word_count))
    found = F.when(F.size("w") > 0, ranges("w", chunk_words, overlap_words))
    cut = counted.select("source", "page", "s", "w", F.posexplode(found).alias("chunk_no", "r"))
    part = lambda c: F.slice(c, F.col("r.lo") + 1, F.col("r.hi") - F.col("r.lo") + 1)
    return cut.select(
        "source",
        "page",
        "chunk_no",
        F.array_join(part("s"), " ").alias("text"),
        F.aggregate(part("w"), F.lit(0), lambda a, x: a + x).alias("n_words"),
        F.col("r.lo").alias("first_sentence"),
        F.col("r.hi").alias("last_sentence"),
    )


def indexed_chunks(pages: DataFrame, chunk_words: int = CHUNK_WORDS, overlap_words: int = OVERLAP_WORDS) -> DataFrame:
    """Chunks with chunk_ix, dense from 0 by (source, page, chunk_no). Pages are put in order, which
    their chunks then have: chunks are written once and never shuffled."""
    return numbered(pages, ["source", "page"], "chunk_ix", lambda ordered: chunk_pages(ordered, chunk_words, overlap_words))
