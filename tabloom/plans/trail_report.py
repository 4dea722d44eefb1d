"""The report of a workbook's trail: one .xlsx with a summary, runs, versions, changes, errors and integrity."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sqlite_integer
from ..operators.sequences import running_total
from ..sources.book import PER_SHEET, Sheet, write_book
from .shared import new_folder, stage
from .trail import CHANGE_TYPES, KEYS, Trail, authoritative, utc_text

#: Names of sheets, and titles of their columns.
RUNS = {"run_id": "ID", "code": "Código", "started_at": "Início", "finished_at": "Fim", "processed": "Versões", "changes": "Alterações", "status": "Status", "message": "Mensagem", "mode": "Modo"}
VERSIONS = {"pair_id": "ID", "previous_id": "Versão anterior", "current_id": "Versão atual", "status": "Status", "changes": "Alterações"}
CHANGES = {"id": "ID global", "previous_id": "Versão anterior", "current_id": "Versão atual", "change_type": "Tipo", "sheet": "Aba", "address": "Endereço", "previous_value": "Valor anterior", "new_value": "Valor novo"}
ERRORS = {"id": "ID", "run_id": "Execução", "stage": "Etapa", "message": "Mensagem", "at": "Data/hora"}
FIELDS = {"field": "Campo", "value": "Valor"}


def _fields(trail: Trail, rows: list[tuple]) -> DataFrame:
    return trail.spark.createDataFrame([(i, name, None if value is None else str(value)) for i, (name, value) in enumerate(rows)], "i bigint, field string, value string")


def write_trail_report(trail: Trail, workbook_id: int, to: str, start: str | None = None, end: str | None = None, per_sheet: int = PER_SHEET, now: dt.datetime | None = None) -> DataFrame:
    """Write the report of a workbook, of pairs between two version ids (both included; None leaves a side open); gives its parts."""
    spark = trail.spark
    own = trail.read("workbook").filter(F.col("workbook_id") == workbook_id).head()
    if own is None:
        raise ValueError("the workbook is not in the trail")
    mine = lambda name: trail.read(name).filter(F.col("workbook_id") == workbook_id)
    low, high = sqlite_integer(F.col("previous_id")), sqlite_integer(F.col("current_id"))
    inside = F.lit(True)
    if start is not None:
        inside &= low >= sqlite_integer(F.lit(start))
    if end is not None:
        inside &= high <= sqlite_integer(F.lit(end))
    pairs = stage(authoritative(mine("pair")).filter(inside), "report-pairs")
    rows = mine("change").join(pairs.select(*KEYS["pair"]), KEYS["pair"], "left_semi").withColumn("_version", high)
    changes = stage(running_total(rows, [], ["_version", "current_id", "previous_id", "sheet", "address"], F.lit(1).cast("bigint"), "id"), "report-changes")
    errors = stage(running_total(mine("error").withColumn("_h", F.xxhash64("run_id", "stage", "message", "at")), [], ["at", "_h"], F.lit(1).cast("bigint"), "id"), "report-errors")
    runs = mine("run")
    versions = running_total(pairs.withColumn("_version", high), [], ["_version", "current_id", "previous_id"], F.lit(1).cast("bigint"), "_n")
    kinds = {r["change_type"]: r["n"] for r in changes.groupBy("change_type").agg(F.count("*").alias("n")).collect()}
    total, first, last = changes.agg(F.count("*"), F.min("id"), F.max("id")).head()
    counts = {"versions": pairs.count(), "runs": runs.count(), "errors": errors.count()}
    stands = mine("checkpoint").head()
    checkpoint = None if stands is None else stands["version_id"]
    identity = "/".join((own["site_id"], own["drive_id"], own["item_id"]))
    summary = [("Planilha", own["name"]), ("Identidade técnica", identity), ("DriveItem ID", own["item_id"]), ("Versões processadas", counts["versions"]), ("Total de alterações", total)]
    summary += [(k, kinds.get(k, 0)) for k in ("ADD", "MOD", "DEL")] + [("Execuções", counts["runs"]), ("Erros", counts["errors"]), ("Checkpoint", checkpoint)]
    if start is not None or end is not None:
        summary.append(("Intervalo solicitado", f"{start or 'início'} → {end or 'fim'}"))
    export, at = uuid.uuid4().hex, utc_text(now or dt.datetime.now(dt.timezone.utc))

    def integrity(parts: DataFrame) -> list[Sheet]:
        written = sorted((r for r in parts.collect()), key=lambda r: (r["place"], r["sheet_no"]))  # a row for each sheet
        of = lambda place: sum(r["n"] for r in written if r["place"] == place)
        if (of(1), of(2), of(3), of(4)) != (counts["runs"], counts["versions"], total, counts["errors"]):
            raise ValueError("the trail changed while its report was written")
        rows = [("Identificação técnica", identity), ("Nome da planilha", own["name"]), ("Data/hora da exportação", at), ("ID único da exportação", export), ("Status da exportação", "CONCLUÍDA")]
        rows += [("Versões no banco", counts["versions"]), ("Versões exportadas", of(2)), ("Alterações no banco", total), ("Alterações exportadas", of(3)), *[(f"{k} no banco", kinds.get(k, 0)) for k in CHANGE_TYPES]]
        rows += [("Número de abas de alterações", sum(r["place"] == 3 for r in written)), ("Primeiro ID global", first), ("Último ID global", last), ("Checkpoint observado", checkpoint), ("Resultado da validação", "VALIDADO")]
        for r in written:
            if r["place"] == 3:
                rows += [(f"Registros em {r['sheet']}", r["n"]), (f"Primeiro ID em {r['sheet']}", r["first"]), (f"Último ID em {r['sheet']}", r["last"])]
        return [Sheet("Integridade", _fields(trail, rows), "i", FIELDS)]

    book = [
        Sheet("Resumo", _fields(trail, summary), "i", FIELDS),
        Sheet("Execuções", runs, "run_id", RUNS),
        Sheet("Versões processadas", versions, "_n", VERSIONS),
        Sheet("Alterações", changes, "id", CHANGES, True),
        Sheet("Erros", errors, "id", ERRORS),
    ]
    return write_book(spark, to, book, new_folder(spark, "report"), per_sheet, integrity)
