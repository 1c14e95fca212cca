"""Plug-in points for what no built-in expresses: PDF parsing, OCR, captions, neural
embedding, answers. Each takes a function from a batch to a batch and runs it over
Arrow; the defaults are deterministic stand-ins that need no library or network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestone.functions.text import strip

Batch = Callable[[list], list]
BATCH = 64
#: Pages, vectors and the like are many times their input as Python objects.
HELD_BYTES = 1 << 20


_loaded: dict[str, object] = {}


def _once(load: Callable[[], Batch]) -> Batch:
    """load()'s function, loaded once in each Python worker process, which Spark uses for many tasks. A hook
    is known by its pickled code and what it closes over."""
    from pyspark.cloudpickle import dumps

    key = hashlib.blake2b(dumps(load)).hexdigest()
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt anew by their keys, so that slow hooks run on all cores: the pages of one
    document are not one task's."""
    return df.repartition(*keys)


def _apply(df: DataFrame, in_col: str, out_col: str, out_type: str, load: Callable[[], Batch], batch: int, keys: list[str] | None = None) -> DataFrame:
    """load() runs once in each worker process (a model is loaded there, not sent); a row that
    fails alone gives null and its error, the others of its batch are kept. keys: deal the rows anew by them first.

    A worker holds what comes of HELD_BYTES of input, or of one batch of the hook if that is more: what is done is passed on."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out_col}` {out_type}", "hook_error string"])
    names, kind = [*df.columns, out_col, "hook_error"], to_arrow_type(StructType.fromDDL(f"x {out_type}")["x"].dataType)
    at = df.columns.index(in_col)

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _once(load)
        for rows in arrived:
            start, held, out, errors = 0, 0, [], []
            for i in range(0, rows.num_rows, batch):
                of = rows.column(at).slice(i, batch)
                part = of.to_pylist()
                try:
                    out += list(f(part))
                    errors += [None] * len(part)
                except Exception:
                    for v in part:
                        try:
                            out += list(f([v]))
                            errors.append(None)
                        except Exception as e:
                            out.append(None)
                            errors.append(f"{type(e).__name__}: {e}"[:500])
                held += of.nbytes
                if held >= HELD_BYTES or i + batch >= rows.num_rows:
                    done = [pa.array(out, kind, from_pandas=True), pa.array(errors, pa.string())]
                    yield pa.RecordBatch.from_arrays([*rows.slice(start, len(part) + i - start).columns, *done], names=names)
                    start, held, out, errors = i + len(part), 0, [], []

    return (spread(df, keys) if keys else df).mapInArrow(run, schema)


def stub_pdf() -> Batch:
    """Pages of plain text, parted by form feeds: a text layer, and lines with bars as one table."""

    def pages(content: bytes) -> list[dict]:
        out = []
        for number, page in enumerate(bytes(content).decode("utf-8", "replace").split("\f"), 1):
            lines = page.split("\n")
            cells = [[c.strip() for c in line.strip().strip("|").split("|")] for line in lines if line.lstrip().startswith("|")]
            blocks = [{"x0": 0.0, "y0": float(k), "text": line} for k, line in enumerate(lines) if not line.lstrip().startswith("|")]
            out.append({"page": number, "page_width": 100.0, "blocks": blocks, "plain": page, "tables": [cells] if cells else []})
        return out

    return lambda files: [pages(f) if f is not None else None for f in files]


def stub_ocr() -> Batch:
    return lambda images: [f" scanned page {hashlib.md5(bytes(x)).hexdigest()}\n" if x is not None else None for x in images]


def stub_caption() -> Batch:
    return lambda images: [f" image {hashlib.md5(bytes(x)).hexdigest()}\n" if x else None for x in images]


def stub_answer() -> Batch:
    """The first line of the prompt's first passage."""

    def first(prompt: str | None) -> str | None:
        _, found, rest = (prompt or "").partition("[SOURCE:")
        return rest.split("\n", 2)[1] if found else None

    return lambda prompts: [first(p) for p in prompts]


def stub_embed(dim: int = 4) -> Callable[[], Batch]:
    """Vectors of the text's MD5 digits, not of unit length."""

    def load() -> Batch:
        return lambda texts: [[float(int(c, 16) + 1) for c in hashlib.md5((t or "").encode()).hexdigest()[:dim]] for t in texts]

    return load


PDF_PAGES = "array<struct<page:int,page_width:double,blocks:array<struct<x0:double,y0:double,text:string>>,plain:string,tables:array<array<array<string>>>>>"


def pdf(files: DataFrame, load: Callable[[], Batch] = stub_pdf, keys: list[str] | None = None) -> DataFrame:
    """A row for each page of each file (doc_md5, content): page, page_width, blocks (x0, y0, text),
    plain (a second text layer), and tables (cells). A file that fails has one row with a null page and its error."""
    read = _apply(files, "content", "pages", PDF_PAGES, load, 1, keys).drop("content")
    kept = [c for c in read.columns if c not in ("pages", "hook_error")]
    return read.select(*kept, "hook_error", F.explode_outer("pages").alias("p")).select(*kept, "hook_error", "p.*")


def blocks_of(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Block rows (keys, page, page_width, block_ix, x0, y0, text) of pdf()'s pages."""
    return pages.select(*keys, "page", "page_width", F.posexplode("blocks").alias("block_ix", "b")).select(*keys, "page", "page_width", "block_ix", "b.*")


def tables_of(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Table rows (keys, page, table_ix, cells) of pdf()'s pages."""
    return pages.select(*keys, "page", F.posexplode("tables").alias("table_ix", "cells"))


def ocr(pages: DataFrame, load: Callable[[], Batch] = stub_ocr, keys: list[str] | None = None) -> DataFrame:
    """Adds ocr_text from `image` (a page's bitmap at 150 dpi), stripped."""
    return _apply(pages, "image", "ocr_text", "string", load, 1, keys).withColumn("ocr_text", strip(F.col("ocr_text")))


def caption(images: DataFrame, load: Callable[[], Batch] = stub_caption, keys: list[str] | None = None) -> DataFrame:
    """Adds caption from `content`, stripped; at most 120 tokens, temperature 0.1 and 10 s are the caller's limits for a remote model."""
    return _apply(images, "content", "caption", "string", load, 1, keys).withColumn("caption", strip(F.col("caption")))


def embed(texts: DataFrame, load: Callable[[], Batch], keys: list[str] | None = None) -> DataFrame:
    """Adds embedding from `text`, in batches of 64, scaled to unit length (a zero vector stays)."""
    made = _apply(texts, "text", "raw_embedding", "array<double>", load, BATCH, keys)
    # the length is bound once: a plain column would be computed anew for each component
    norm = F.sqrt(F.aggregate("raw_embedding", F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda n: F.when(n > 0, F.transform("raw_embedding", lambda x: x / n)).otherwise(F.col("raw_embedding"))
    unit = F.element_at(F.transform(F.array(norm), scaled), 1)
    return made.withColumn("embedding", unit.cast("array<float>")).drop("raw_embedding")


def answer(prompts: DataFrame, load: Callable[[], Batch] = stub_answer) -> DataFrame:
    """Adds answer from `prompt`."""
    return _apply(prompts, "prompt", "answer", "string", load, 1)


def encoded(images: DataFrame) -> DataFrame:
    """Adds the base64 text that remote models take."""
    return images.withColumn("encoded", F.base64("content"))
