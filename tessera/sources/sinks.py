"""Sinks: spreadsheet-safe CSV, envelopes, logs with digests, small workbooks."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import cost_usd
from tessera.functions.text import csv_cell


def csv_lines(df: DataFrame) -> DataFrame:
    """(line): every cell quoted and safe. Write with write_csv() or df.write.text."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(c).cast("string")) for c in df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of part files with CRLF line ends; the header is the first line of each that has rows."""
    head = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # the first row of its partition, which is a file
    line = F.concat(F.when(first, head + "\r\n").otherwise(""), "line", F.lit("\r"))
    csv_lines(df).select(line.alias("line")).write.option("lineSep", "\n").text(path)


def envelope(data: Column) -> Column:
    return F.to_json(F.struct(F.lit(True).alias("ok"), data.alias("data")))


def error_envelope(code: str, message: Column) -> Column:
    return F.to_json(F.struct(F.lit(False).alias("ok"), F.struct(F.lit(code).alias("code"), message.alias("message")).alias("error")))


def with_digest(decisions: DataFrame, inputs: list[str]) -> DataFrame:
    """An append log's rows with the SHA-256 of their inputs as JSON."""
    return decisions.withColumn("input_digest", F.sha2(F.to_json(F.struct(*inputs)), 256))


def usage_rows(calls: DataFrame, price_in: float = 2.0, price_out: float = 8.0) -> DataFrame:
    """(model, purpose, request_id, tokens_in, tokens_out) -> rows of the usage log: an id of the call's own and its cost. A call that is told twice has one id."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("request_id", "purpose", "model")])
    return calls.select(F.sha2(key, 256).alias("id"), "model", "purpose", "request_id", "tokens_in", "tokens_out", cost_usd("tokens_in", "tokens_out", price_in, price_out).alias("cost_usd"))


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Adds a batch to a log. Its number is in the path, so a batch that runs again replaces itself; read with logged()."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def logged(spark, path: str) -> DataFrame:
    """All rows of a log with the number of their batch; a day's or a batch's rows are read alone by a filter on it."""
    return spark.read.parquet(path)


def write_workbook(df: DataFrame, path: str, most: int = 100_000) -> int:
    """A one-sheet workbook of a report; more than `most` rows raise, since a sheet is for people."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write CSV or Parquet")
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [df.columns, *rows])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + xml)
    return len(rows)
