"""Packages in a binary column: parts, blocks, paragraph properties, and writing inferred blocks back as packages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators import infer_kernel as I
from paperloom.operators import markup_kernel as M
from paperloom.operators import office_kernel as K
from paperloom.operators.markup import BLOCK, _block
from paperloom.plans.workspace import ship

PROPS = (
    "struct<text:string,style_id:string,align:string,size:double,indent:double,first_line:double,space_before:double,space_after:double,line_multiple:double,line_exact:double,line_at_least:boolean,"
    "contextual_spacing:boolean,page_break_before:boolean,rtl:boolean>"
)
_props = pa.struct([
    ("text", pa.string()), ("style_id", pa.string()), ("align", pa.string()), ("size", pa.float64()), ("indent", pa.float64()), ("first_line", pa.float64()), ("space_before", pa.float64()),
    ("space_after", pa.float64()), ("line_multiple", pa.float64()), ("line_exact", pa.float64()), *[(c, pa.bool_()) for c in ("line_at_least", "contextual_spacing", "page_break_before", "rtl")],
])
_setup = pa.struct([("width", pa.float64()), ("height", pa.float64()), ("margin", pa.float64()), ("columns", pa.int32()), ("column_gap", pa.float64())])
DOCUMENT = f"struct<blocks:array<{BLOCK}>,paragraphs:array<{PROPS}>,setup:struct<width:double,height:double,margin:double,columns:int,column_gap:double>,matched:int,missed:int,warning:string>"
_document = pa.struct([("blocks", pa.list_(_block)), ("paragraphs", pa.list_(_props)), ("setup", _setup), ("matched", pa.int32()), ("missed", pa.int32()), ("warning", pa.string())])


def _read(data: bytes) -> dict:
    try:
        parts = K.unzip(data)
    except Exception as error:  # any damage to a package: the row says so and the job goes on
        return {"warning": f"not a readable package: {error}"[:200]}
    body = parts.get("word/document.xml")
    blocks = K.read_blocks(body, K.numbering(parts.get("word/numbering.xml")))
    props = K.paragraphs(body, K.styles(parts.get("word/styles.xml")))
    _, matched, missed = K.correlate(blocks, props)
    return {"blocks": [b | {"text": M.block_text(b)} for b in blocks], "paragraphs": props, "setup": K.page_setup(body), "matched": matched, "missed": missed}


def read(content: Column) -> Column:
    """Blocks, paragraph properties and page setup of a package; a damaged one has a warning."""

    @F.arrow_udf(DOCUMENT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for files in batches:
            yield pa.array([None if f is None else _read(f) for f in (x.as_py() for x in files)], _document)

    return run.asNondeterministic()(content)


def write_packages(blocks: DataFrame, **options) -> DataFrame:
    """(doc_id, content): blocks of :mod:`infer` as one package a document, pages apart."""
    ship(blocks.sparkSession)

    def work(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["page", "seq"])
        out: list[I.Block] = []
        for page, rows in pdf.groupby("page", sort=True):
            out += [I.Block("pagebreak")] if out else []
            for r in rows.itertuples():
                known = lambda v: None if pd.isna(v) else int(v)
                cells = None if r.cells is None else [[[I.Span(c, 11.0, 0.0, 0.0)] if c else [] for c in row] for row in r.cells]
                out.append(I.Block(r.kind, [I.Span(**s) for s in r.spans], known(r.level), r.marker, known(r.indent), known(r.depth), cells))
        return pd.DataFrame([(key[0], K.package(K.build(out, **options)))], columns=["doc_id", "content"])

    return blocks.groupBy("doc_id").applyInPandas(work, "doc_id long, content binary")


def zip_batch(files: DataFrame, batch: str, name: str, content: str, order: str) -> DataFrame:
    """(batch, content): files of a batch in one stored ZIP. A batch is what one caller saves at once, 200 MB at most."""
    ship(files.sparkSession)

    def work(key, pdf):
        import pandas as pd

        return pd.DataFrame([(key[0], K.package(dict(zip(pdf.sort_values("o")["n"], pdf.sort_values("o")["c"], strict=True)), stored=True))], columns=["batch", "content"])

    picked = files.select(F.col(batch).alias("batch"), F.col(name).alias("n"), F.col(content).alias("c"), F.col(order).alias("o"))
    return picked.groupBy("batch").applyInPandas(work, f"batch {dict(files.dtypes)[batch]}, content binary")
