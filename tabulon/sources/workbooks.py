"""Excel workbooks, from bytes Spark has read: one task cuts a sheet into parts, many parse them.

Cutting unpacks the sheet and looks for ends of rows; a part is a small sheet of its own, with the rows
it has, the shared strings those rows refer to, and what is needed to read dates. Parsing the cells, which
is most of the work, is thereby spread over as many tasks as there are parts, also for one large workbook.
A task holds one workbook or a few parts at a time, however many it is given.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, functions as F, types as T

from tabulon.session import materialize

#: Bytes of sheet a part has, about.
PART_BYTES = 1 << 20
PART = "path string, head string, xml binary, strings string, styles string, is_first boolean"

# Namespaces of the spreadsheet format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _plain(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


# The format's built-in numbers of date and time styles, and its day zero.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
DAY_ZERO, DAY_ZERO_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style, whether it shows a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {}
    for f in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        own[int(f.get("numFmtId"))] = bool(re.search("[ymdhs]", code, re.IGNORECASE))
    cells = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return [own.get(i, i in DATE_FORMATS) for i in ids]


#: A cell that refers to a shared string, up to the string's number.
_REFERENCE = re.compile(
    rb"""\bt=["']s["'][^>]*>\s*(?:<(?:\w+:)?f\b[^>]*/>|<(?:\w+:)?f\b.*?</(?:\w+:)?f>)?\s*<(?:\w+:)?v[^>]*>\s*(\d+)""", re.DOTALL
)
_ROWS_BEGIN = re.compile(rb"<(\w+:)?sheetData\b[^>]*?(/?)>")


def _open_sheet(book: zipfile.ZipFile):
    """The stream of the first sheet, and whether the workbook counts days from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    options = root.find(f"{MAIN}workbookPr")
    sheet = root.find(f"{MAIN}sheets")[0]
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == sheet.get(RELATION))
    name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return book.open(name), options is not None and options.get("date1904") in ("1", "true")


def _row_blocks(stream, size: int) -> Iterator[bytes]:
    """The sheet as complete small sheets of about `size` bytes each, at least one."""
    data = stream.read(size)
    while not (begin := _ROWS_BEGIN.search(data)) and (more := stream.read(size)):
        data += more
    # Other encodings, and markup in which an end of a row could be text, are left in one piece.
    if not begin or begin[2] or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        yield data + stream.read()
        return
    prefix = begin[1] or b""
    root = re.search(rb"<([\w:]+)", data)[1]
    opening, closing = data[: begin.end()], b"</%ssheetData></%s>" % (prefix, root)
    row_end, rows_end = b"</%srow>" % prefix, b"</%ssheetData>" % prefix
    rest = data[begin.end() :]
    whole = b"<![CDATA[" in rest or b"<!--" in rest
    while more := stream.read(size):
        whole = whole or b"<![CDATA[" in more or b"<!--" in more
        rest += more
        cut = rest.rfind(row_end)
        if not whole and cut >= 0 and rows_end not in rest:
            yield opening + rest[: cut + len(row_end)] + closing
            rest = rest[cut + len(row_end) :]
    yield opening + rest


def sheet_parts(content: bytes, size: int = PART_BYTES) -> Iterator[tuple[str, bytes, str, str, bool]]:
    """`head, xml, strings, styles, is_first` of the parts of the first sheet, ready to be parsed anywhere."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_plain(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    stream, from_1904 = _open_sheet(book)
    styles, head = json.dumps([_date_styles(book), from_1904]), None
    with stream:
        for block in _row_blocks(stream, size):
            used = {int(x) for x in _REFERENCE.findall(block)}
            strings = json.dumps({i: shared[i] for i in used})
            first = head is None
            if first:
                head = json.dumps(next(_rows(block, strings, styles), {}))
            yield head, zlib.compress(block, 1), strings, styles, first


def _rows(block: bytes, strings: str, styles: str) -> Iterator[dict[int, tuple[str, str]]]:
    """Rows as column number -> (kind, text); missing cells and errors are absent.

    Kinds are text, number, date and bool. Dates are written as in SQL.
    """
    shared, (dates, from_1904) = json.loads(strings), json.loads(styles)
    zero = DAY_ZERO_1904 if from_1904 else DAY_ZERO
    for _, node in ElementTree.iterparse(io.BytesIO(block)):
        if node.tag != f"{MAIN}row":
            continue
        row = {}
        for i, cell in enumerate(node.findall(f"{MAIN}c")):
            at = _column_number(cell.get("r")) if cell.get("r") else i
            value, kind = cell.find(f"{MAIN}v"), cell.get("t", "n")
            style = int(cell.get("s", -1))
            if kind == "inlineStr":
                row[at] = ("text", _plain(cell))
            elif value is None or value.text is None or kind == "e":
                continue
            elif kind == "s":
                row[at] = ("text", shared[value.text.strip()])
            elif kind == "b":
                row[at] = ("bool", "true" if value.text == "1" else "false")
            elif kind == "n" and 0 <= style < len(dates) and dates[style]:
                moment = zero + timedelta(seconds=round(float(value.text) * 86400))
                row[at] = ("date", moment.isoformat(" "))
            else:
                row[at] = ("number" if kind == "n" else "text", value.text)
        node.clear()
        yield row


def part_rows(xml: bytes, strings: str, styles: str, is_first: bool) -> Iterator[dict[int, tuple[str, str]]]:
    """The rows of a part, without the header."""
    rows = _rows(zlib.decompress(xml), strings, styles)
    if is_first:
        next(rows, None)
    return rows


def cut_workbooks(books: DataFrame) -> DataFrame:
    """The parts of all workbooks in `books` (`path, content`), dealt out anew."""

    def cut(row):
        return ((row["path"], *part) for part in sheet_parts(bytes(row["content"])))

    spark = books.sparkSession
    # As rows, not in Arrow batches: those are counted in rows, and so would hold every workbook of a task at once.
    parts = spark.createDataFrame(books.select("path", "content").rdd.flatMap(cut), PART, verifySchema=False)
    return parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def header_of(row: dict[int, tuple[str, str]], width: int) -> list[str]:
    """Column names: a blank header is named by its place, a repeated one gets a number."""
    out: list[str] = []
    for i in range(width):
        name = row.get(i, ("", ""))[1] or f"column_{i}"
        k = 2
        while name in out:
            name, k = f"{row.get(i, ('', ''))[1] or f'column_{i}'}_{k}", k + 1
        out.append(name)
    return out


def _head(text: str) -> dict[int, tuple[str, str]]:
    return {int(at): tuple(cell) for at, cell in json.loads(text).items()}


def _columns(parts: DataFrame) -> DataFrame:
    """`path, at, name, kind`: the kinds of cells in each column of each part."""

    def find(r):
        head, kinds = _head(r["head"]), {}
        for row in part_rows(r["xml"], r["strings"], r["styles"], r["is_first"]):
            for at, (kind, text) in row.items():
                whole = kind == "number" and re.fullmatch(r"-?[0-9]{1,18}(\.0*)?", text)
                kinds.setdefault(at, set()).add("whole" if whole else kind)
        width = max([*head, *kinds], default=-1) + 1
        return [(r["path"], i, n, k) for i, n in enumerate(header_of(head, width)) for k in kinds.get(i, {"none"})]

    schema = "path string, at int, name string, kind string"
    return parts.sparkSession.createDataFrame(parts.rdd.flatMap(find), schema, verifySchema=False)


def infer_schema(parts: DataFrame) -> T.StructType:
    """All columns of all workbooks, given as parts, in order of first appearance, typed by their cells.

    Only numbers give long or double, only dates timestamp, only booleans boolean; anything else is
    text. One row per column reaches the driver.
    """
    found = (
        _columns(parts).groupBy("name")
        .agg(F.min(F.struct("path", "at")).alias("first"), F.collect_set("kind").alias("kinds"))
        .orderBy("first").collect()
    )
    fields = []
    for r in found:
        kinds = set(r["kinds"]) - {"none"}
        if kinds and kinds <= {"whole", "number"}:
            dtype = T.LongType() if kinds == {"whole"} else T.DoubleType()
        elif kinds == {"date"}:
            dtype = T.TimestampNTZType()
        else:
            dtype = T.BooleanType() if kinds == {"bool"} else T.StringType()
        fields.append(T.StructField(r["name"], dtype))
    return T.StructType(fields)


def parse_workbooks(books: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of the first sheet of every workbook in `books` (`path, content`).

    Cells are matched to the schema by header name; without a schema, `infer_schema` gives it. The workbooks
    are opened once either way.
    """
    parts = materialize(cut_workbooks(books), "workbooks")
    if schema is None:
        schema = infer_schema(parts)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = [f.name for f in schema.fields]

    def parse(r):
        head = _head(r["head"])
        # Cells to the right of the header belong to blank headers.
        last = max([*head, *(int(n[7:]) for n in names if re.fullmatch("column_[0-9]+", n))], default=-1)
        header = {name: i for i, name in enumerate(header_of(head, last + 1))}
        at = [header.get(n, -1) for n in names]
        for row in part_rows(r["xml"], r["strings"], r["styles"], r["is_first"]):
            yield tuple(row[i][1] if i in row else None for i in at)

    as_text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    texts = parts.sparkSession.createDataFrame(parts.rdd.flatMap(parse), as_text, verifySchema=False)
    return texts.select(*[_typed(f).alias(f.name) for f in schema.fields])


def _typed(field: T.StructField):
    cell = F.col("`" + field.name.replace("`", "``") + "`")
    if isinstance(field.dataType, T.BooleanType):
        return F.when(cell.isin("1", "0"), cell == "1").otherwise(cell.try_cast(field.dataType))
    if isinstance(field.dataType, T.LongType):
        return F.coalesce(cell.try_cast("long"), cell.try_cast("double").try_cast("long"))
    if isinstance(field.dataType, (T.IntegerType, T.LongType, T.ShortType)):
        return cell.try_cast("double").try_cast(field.dataType)
    return cell.try_cast(field.dataType)
