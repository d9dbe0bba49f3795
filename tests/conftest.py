"""One small session, and copies of the smallest tables with the defects that operators must bear."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("REEFGLASS_TESTDATA", "/root/testdata/sf0.001"))
GROWING = ("search_document", "document_spec", "iulaan", "enriched_record", "documents")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data_dir() -> str:
    if not DATA.exists():
        pytest.skip("the driver's tables are not here")
    return str(DATA)


def _write(folder: Path, change) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    for p in DATA.glob("*.parquet"):
        pq.write_table(change(p.stem, pq.read_table(p)), folder / p.name)
    return str(folder)


def _with_nulls(name: str, t: pa.Table) -> pa.Table:
    """Rows that are null in every column but the id, rows of extremes, and every row twice."""
    if name not in GROWING:
        return t
    t = t.slice(0, 40)
    empty = pa.table({f.name: pa.nulls(2, f.type) for f in t.schema}, schema=pa.schema([f.with_nullable(True) for f in t.schema]))
    rows = t.slice(0, 3).to_pylist()
    odd = []
    for i, r in enumerate(rows):
        for f in t.schema:
            if pa.types.is_string(f.type) and f.name not in ("source", "dedupe_key", "iulaan_id", "source_key", "key_raw"):
                r[f.name] = ("", "   ", "word " * 20_000)[i]
            elif pa.types.is_floating(f.type):
                r[f.name] = (float("nan"), float("inf"), -1e300)[i]
        odd.append(r)
    return pa.concat_tables([t, t, empty, pa.Table.from_pylist(odd, t.schema)], promote_options="permissive")


def _with_extra(name: str, t: pa.Table) -> pa.Table:
    """Columns that operators use for themselves or that other tables have."""
    for c in ("_salt", "k1", "value", "label", "text", "bucket", "n", "tokens", "weight", "source", "spec_key", "unit_code", "quantity", "verdict", "form", "id", "pid", "lang"):
        if c not in t.column_names:
            t = t.append_column(c, pa.array(["x"] * len(t)))
    return t


@pytest.fixture(scope="session")
def variants(tmp_path_factory, data_dir):
    base = tmp_path_factory.mktemp("variants")
    return {
        "plain": data_dir,
        "empty": _write(base / "empty", lambda n, t: t.slice(0, 0) if n in GROWING else t),
        "all_empty": _write(base / "all_empty", lambda n, t: t.slice(0, 0)),
        "nulls": _write(base / "nulls", _with_nulls),
        "extra": _write(base / "extra", _with_extra),
        "one_key": _write(base / "one_key", _one_key),
    }


def _one_key(name: str, t: pa.Table) -> pa.Table:
    """All rows in one group: one key, one source, one document, one text."""
    one = {"dedupe_key": "same", "key_raw": "brand", "source": "gazette", "text": "The same text comes in every row of the table.", "summary_en": "The same summary ends here.", "contact_phone": "5555123"}
    if name not in GROWING:
        return t
    for c, v in one.items():
        if c in t.column_names:
            t = t.set_column(t.column_names.index(c), c, pa.array([v] * len(t), t.schema.field(c).type))
    return t
