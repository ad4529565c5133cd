"""JSON documents by job, and exports, through Spark's writers and Hadoop's file systems."""

import io
import math
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.sax.saxutils import escape

from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import EXPORT
from .archives import uri


def put(document: DataFrame, root: str, job_id: str, name: str = "metrics") -> None:
    document.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/{job_id}/{name}")


def put_pieces(pieces: DataFrame, root: str, name: str = "metrics", key: str = "job_id") -> None:
    """Writes documents in pieces (key, text and the columns that order it): a folder for each key, whose files follow each other by name.

    Ranges of all pieces are dealt to tasks, so the files of a large document come from many of them; read one after the
    other, they are the document, each piece on a line of its own. Documents of other keys stay.
    """
    order = [key, *(c for c in pieces.columns if c not in (key, "text"))]
    placed = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select(key, "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(f"{root}/{name}")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def get(spark: SparkSession, root: str, job_id: str, schema: StructType, name: str = "metrics") -> DataFrame:
    """The document; no rows if there is none."""
    fs, p = _fs(spark, f"{root}/{job_id}/{name}")
    return spark.read.schema(schema).json(p.toString()) if fs.exists(p) else spark.createDataFrame([], schema)


def delete_job(spark: SparkSession, root: str, job_id: str) -> None:
    fs, p = _fs(spark, f"{root}/{job_id}")
    fs.delete(p, True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file; none is no error."""
    fs, p = _fs(spark, path)
    fs.delete(p, False)


def upload(spark: SparkSession, root: str, job_id: str, local: str, name: str) -> None:
    fs, p = _fs(spark, f"{root}/{job_id}/{name}")
    fs.copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(local), p)


#: Fixed values of the sheet: fills of the heading and of every second row.
HEADING, STRIPE = "FF4472C4", "FFE9EBF5"
SHEET = "Campaign Results"


#: Control characters that no sheet may hold.
_UNSEEN = {c: None for c in range(32) if c not in (9, 10, 13)}


def _column(i: int) -> str:
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def _cell(at: str, value: object, style: object) -> str:
    if value is None:
        return f'<c r="{at}" s="{style}"/>'
    if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value):
        return f'<c r="{at}" s="{style}"><v>{value}</v></c>'
    return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value).translate(_UNSEEN))}</t></is></c>'


def _row(number: object, values: Iterable, style: object) -> str:
    return f'<row r="{number}">' + "".join(_cell(f"{_column(i)}{number}", v, style) for i, v in enumerate(values)) + "</row>"


def _stripe(number: int) -> int:
    return 3 if number % 2 == 0 else 2


def _book(out: BinaryIO, columns: list[str], body: Iterable[str], sheet: str) -> None:
    """Writes the file around the rows, which are taken one by one."""
    known = {name: (title, width) for name, title, width in EXPORT}
    widths = "".join(f'<col min="{i}" max="{i}" width="{known.get(c, (c, 14))[1]}" customWidth="1"/>' for i, c in enumerate(columns, 1))
    head = _row(1, (known.get(c, (c, 14))[0] for c in columns), 1)
    main, rel, pkg = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    fill = lambda colour: f'<fill><patternFill patternType="solid"><fgColor rgb="{colour}"/><bgColor rgb="{colour}"/></patternFill></fill>'
    thin = "".join(f'<{side} style="thin"/>' for side in ("left", "right", "top", "bottom"))
    styles = (
        '<fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts>'
        f'<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill(HEADING)}{fill(STRIPE)}</fills>'
        f'<borders count="2"><border/><border>{thin}</border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/>'
        '<xf fontId="1" fillId="2" borderId="1" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1"><alignment horizontal="center"/></xf>'
        '<xf borderId="1" applyBorder="1"/><xf fillId="3" borderId="1" applyFill="1" applyBorder="1"/></cellXfs>'
    )
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}">{styles}</styleSheet>',
    }
    declared = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    entry = lambda name: zipfile.ZipInfo(name)  # noqa: E731 - of a fixed date, so that equal rows make equal files
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, xml in parts.items():
            archive.writestr(entry(name), declared + xml, zipfile.ZIP_DEFLATED)
        last = entry("xl/worksheets/sheet1.xml")
        last.compress_type = zipfile.ZIP_DEFLATED
        with archive.open(last, "w") as part:
            part.write(f'{declared}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData>{head}'.encode())
            for row in body:
                part.write(row.encode())
            part.write(b"</sheetData></worksheet>")


def spreadsheet(rows: DataFrame, limit: int = 10_000, sheet: str = SHEET) -> bytes:
    """The rows as an XLSX file of one sheet; at most `limit` rows, as the export has.

    The heading is frozen, white and bold on blue, every second row is striped, cells have thin borders, numbers are
    numbers and nulls are empty. Columns of the export have its headings and widths, others their names. Rows come to the
    driver one partition at a time; see Xlsx for a sink that renders them in tasks.
    """
    out = _Held()
    _book(out, rows.columns, (_row(n, r, _stripe(n)) for n, r in enumerate(rows.limit(limit).toLocalIterator(), 2)), sheet)
    return out.held.getvalue()


class _Held:
    """Memory as a stream that only goes forward, as stores have, so that a file is the same wherever it is written."""

    def __init__(self) -> None:
        self.held = io.BytesIO()

    def write(self, some: bytes) -> int:
        return self.held.write(some)

    def flush(self) -> None:
        pass


#: Where a row's number and style will stand; characters that no XML text has.
_NUMBER, _STYLE = "\x01", "\x02"


def _store(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri(path))


@dataclass
class Fragment(WriterCommitMessage):
    part: int
    file: str


class XlsxWriter(DataSourceWriter):
    """Tasks render their rows into fragments; the commit numbers and joins them, in the order of the partitions, into the file."""

    def __init__(self, path: str, columns: list[str], sheet: str, overwrite: bool):
        self.path, self.columns, self.sheet, self.overwrite = path, columns, sheet, overwrite
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"
        store, root = _store(self.parts)
        store.create_dir(root, recursive=True)  # once, so that a task which ends after the abort can't bring it back

    def write(self, iterator: Iterator[Row]) -> Fragment:
        task = TaskContext.get()
        store, root = _store(self.parts)
        file = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}"
        with store.open_output_stream(file) as out:
            for r in iterator:
                out.write((_row(_NUMBER, r, _STYLE).replace("\n", "&#10;") + "\n").encode())
        return Fragment(task.partitionId(), file)

    def _rows(self, messages: list[Fragment]) -> Iterator[str]:
        store, _ = _store(self.parts)
        n = 1
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            with store.open_input_stream(m.file) as file:
                for line in io.TextIOWrapper(io.BufferedReader(file), "utf-8", newline="\n"):
                    n += 1
                    yield line[:-1].replace(_NUMBER, str(n)).replace(_STYLE, str(_stripe(n))).replace("&#10;", "\n")

    def commit(self, messages: list[Fragment]) -> None:
        store, name = _store(self.path)
        if not self.overwrite and store.get_file_info(name).type != FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.path} is there already")
        with store.open_output_stream(f"{name}.new") as out:
            _book(out, self.columns, self._rows(messages), self.sheet)
        store.move(f"{name}.new", name)
        self.abort(messages)

    def abort(self, messages: list[Fragment]) -> None:
        store, root = _store(self.parts)
        if store.get_file_info(root).type != FileType.NotFound:
            store.delete_dir(root)


class Xlsx(DataSource):
    """df.write.format("xlsx").mode("overwrite").save(path), once registered with the session's data sources; option sheet.

    All rows are written, in their order; limit them before. Appending to a file that is there is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options["path"], schema.fieldNames(), self.options.get("sheet", SHEET), overwrite)
