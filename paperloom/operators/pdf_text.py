"""PDF files to the table of positioned text that layout inference starts from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.workspace import ship

ITEM = "struct<seq:int,text:string,transform:array<double>,width:double,height:double,font:string>"
FOUND = f"struct<error:string,pages:array<struct<page:int,width:double,height:double,image_count:int,fonts:array<string>,items:array<{ITEM}>>>>"
_item = pa.struct([("seq", pa.int32()), ("text", pa.string()), ("transform", pa.list_(pa.float64())), ("width", pa.float64()), ("height", pa.float64()), ("font", pa.string())])
_page = pa.struct([("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("image_count", pa.int32()), ("fonts", pa.list_(pa.string())), ("items", pa.list_(_item))])


def read(content: Column, password: Column | None = None) -> Column:
    """A file's pages with their items, fonts and number of pictures, or why it can't be read; null for null."""
    from paperloom.operators import pdf_text_kernel as K

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for files, passwords in batches:
            out = [None if f is None else K.read(f, p) for f, p in zip(files.to_pylist(), passwords.to_pylist(), strict=True)]
            yield pa.array(out, pa.struct([("error", pa.string()), ("pages", pa.list_(_page))]))

    return run.asNondeterministic()(content, F.lit(None).cast("string") if password is None else password)


def pages_of(files: DataFrame, id_col: str, content: str, password: str | None = None) -> DataFrame:
    """(doc_id, error, page, width, height, image_count, fonts, items): a row a page, one with an error for a file without."""
    ship(files.sparkSession)
    found = files.select(F.col(id_col).cast("long").alias("doc_id"), read(F.col(content), F.col(password) if password else None).alias("r"))
    return found.select("doc_id", "r.error", F.inline_outer("r.pages"))


def items_of(pages: DataFrame) -> DataFrame:
    """Pages to (doc_id, page, seq, text, x, y, width, size, font), as layout inference takes them."""
    from paperloom.operators.infer import normalise_items

    return normalise_items(pages.select("doc_id", "page", F.inline("items")))


def documents(files: DataFrame, id_col: str, content: str, keep_furniture: bool = False) -> DataFrame:
    """Files to the blocks of their text."""
    from paperloom.operators import infer

    from paperloom.plans.workspace import save

    pages = save(pages_of(files, id_col, content), "pdf_pages")
    return infer.documents(items_of(pages), pages.where("page is not null").select("doc_id", "page", "width", "height"), keep_furniture)


def _rewrite(work, content: Column, *words: Column) -> Column:
    @F.arrow_udf("struct<content:binary,error:string>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            out = [None if f is None else work(f, *w) for f, *w in zip(*(c.to_pylist() for c in columns), strict=True)]
            yield pa.array(out, pa.struct([("content", pa.binary()), ("error", pa.string())]))

    return run.asNondeterministic()(content, *words)


def protect(content: Column, user: Column, owner: Column, cipher: str = "AES-256", **permissions) -> Column:
    """(content, error) of files sealed with two passwords, AES-256 or AES-128; permissions as ``permission_bits`` takes them."""
    from paperloom.operators import pdf_seal_kernel as K

    allowed = K.permission_bits(**permissions)
    return _rewrite(lambda f, u, o: K.protect(f, u or "", o, allowed, cipher), content, user, owner)


def unlock(content: Column, password: Column) -> Column:
    """(content, error) of files without their password."""
    from paperloom.operators import pdf_seal_kernel as K

    return _rewrite(K.unlock, content, password)
