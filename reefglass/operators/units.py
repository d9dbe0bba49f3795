"""Problem 6: quantities recorded in different units -> common units.

Per row, the unit is taken from the unit column, else from the value's text, else from the key
("Length_in"). Only a spelling of a unit of the attribute's own quantity counts. Rows without one get a
unit from a latent-unit model: on a log scale the values of an attribute form one mixture whose
components differ by the known conversion factors. The base distribution comes from the rows with a
written unit; the components' weights per source are fitted by EM, with the unit that the source's note
(or else the registry) names as prior. Each such row gets the unit with the largest posterior;
``uncertain`` marks those under ``CERTAIN``. ``trust_notes`` makes the documented unit binding instead;
then ``uncertain`` marks rows whose value speaks against it.

What leaves the executors for EM is a histogram: attributes x documented sources x units x 200 bins, a
bound that does not depend on the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass.checkpoints import cut
from reefglass.functions import units as U
from reefglass.operators.spec_keys import Registry, hot_documents, lookup, of_live_documents, resolve_keys
from reefglass.sources.tables import fixed_rows, local_table, read_table

BIN = 0.25  #: width of a histogram bin, in natural logarithms
LOW_BIN, HIGH_BIN = -60, 139  #: bins outside are clamped: 200 bins
CERTAIN = 0.9
#: What the documented unit is worth before a value is seen, and in rows; the likelihood of a value far from every component.
NOTE_SHARE, NOTE_ROWS, FAR = 0.98, 200.0, 1e-4
ROUNDS = 30


def note_units(sources: DataFrame, registry: Registry) -> tuple[dict[str, str], list[str]]:
    """('source|quantity' -> unit code named by the source's note, the documented sources).

    doc_source has a fixed, small number of rows (one per source); its notes are read on the driver.
    Spellings of several words go first; those under four letters are too common as words.
    """
    code = {s: c for s, codes in registry.spellings.items() if len(s) >= 4 for c in codes if c in registry.units}
    found: dict[str, str] = {}
    rows = fixed_rows(sources.select("source", "note"))
    for r in rows:
        words = [w.strip(".,;:()").lower() for w in (r.note or "").split()]
        i = 0
        while i < len(words):
            for n in (3, 2, 1):
                c = code.get("".join(words[i : i + n])) if i + n <= len(words) else None
                if c is not None:
                    found.setdefault(f"{r.source}|{registry.units[c][0]}", c)
                    i += n
                    break
            else:
                i += 1
    return found, sorted({r.source for r in rows if r.source})


def quantities(spark: SparkSession, data_dir: str, registry: Registry) -> DataFrame:
    """One row per delivered document_spec row with a readable quantity of an attribute with a common unit, document existing or not.

    Columns: spec_id, document_id, spec_key, quantity, common_unit, value, written_unit (null if none), extracted_at.
    """
    specs = read_table(spark, data_dir, "document_spec", "spec_id", "document_id", "key_id", "key_raw", "value_num", "value_text", "unit", "extracted_at")
    rows = resolve_keys(spark, specs, registry).where("unit_code is not null").withColumnRenamed("unit_code", "common_unit")
    # a row per spelling of a quantity's unit: the fixed spellings and the registry's
    spelled = [(*k.split("|", 1), c) for k, c in registry.scoped_units().items()]
    rows = rows.withColumn("quantity", lookup(registry.quantities, F.col("spec_key")))

    def coded(df: DataFrame, key: Column, name: str) -> DataFrame:
        table = local_table(spark, spelled, _q="string", _s="string", **{name: "string"})
        return df.withColumn("_key", key).join(F.broadcast(table), (F.col("quantity") == F.col("_q")) & (F.col("_key") == F.col("_s")), "left").drop("_q", "_s", "_key")

    text = F.when(F.trim(F.coalesce("value_text", F.lit(""))) != "", F.col("value_text"))
    rows = coded(rows, U.unit_key(F.col("unit")), "_written")
    rows = coded(rows, F.when(F.col("_written").isNull(), U.text_unit_key(text)), "_in_text")
    rows = coded(rows, F.when(F.coalesce("_written", "_in_text").isNull(), F.col("key_unit")), "_in_key")
    return rows.select(
        "spec_id", "document_id", "spec_key", "quantity", "common_unit", "extracted_at",
        F.coalesce(U.finite(F.col("value_num")), U.read_number(text)).alias("value"), F.coalesce("_written", "_in_text", "_in_key").alias("written_unit"),
    ).where("value is not null")


def _bin(c: Column) -> Column:
    return F.greatest(F.lit(LOW_BIN), F.least(F.lit(HIGH_BIN), F.floor(F.log(c) / BIN).cast("int")))


def fit_units(rows: DataFrame, registry: Registry, sources: list[str], rounds: int = ROUNDS) -> list[tuple[str, str, int, str, float]]:
    """EM over histograms; [(spec_key, source, bin, unit_code, posterior)], a table of bounded size.

    An attribute's values form one log-scale mixture: a component per unit of its quantity, all of one
    shape, offset by the conversion factors; the shape comes from the rows with a written unit, or from
    the documented unit where there are none. Its weights are those of the source. The documented unit
    has the prior NOTE_SHARE. Affine units (temperatures) are compared on the values converted.
    """
    binned = (
        rows.where("value > 0")
        .groupBy("spec_key", F.when(F.col("source").isin(*sources), F.col("source")).otherwise(F.lit("")).alias("source"), "written_unit", "note_unit", "common_unit", _bin(F.col("value")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    ).collect()
    conv = registry.units
    of_quantity: dict[str, list[str]] = {}
    for code, (q, _, _) in sorted(conv.items()):
        of_quantity.setdefault(q, []).append(code)

    def common_log(b: int, code: str) -> float:
        _, factor, offset = conv[code]
        v = math.exp((b + 0.5) * BIN) * factor + offset
        return v / 20.0 if offset or any(conv[c][2] for c in of_quantity[conv[code][0]]) else math.log(max(v, 1e-12))

    out = []
    for key, q in sorted(registry.quantities.items()):
        codes = of_quantity[q]
        mine = [r for r in binned if r.spec_key == key]
        base = [(common_log(r.bin, r.written_unit), r.n) for r in mine if r.written_unit]
        if not base:
            base = [(common_log(r.bin, r.note_unit or r.common_unit), r.n) for r in mine]
        if not base:
            continue
        x, n = np.array([b[0] for b in base]), np.array([b[1] for b in base], float)
        mean = float((x * n).sum() / n.sum())
        sd = max(0.3, math.sqrt(float(((x - mean) ** 2 * n).sum() / n.sum())))
        by_source: dict[str, dict[int, float]] = {}
        default: dict[str, str] = {}
        for r in mine:
            if not r.written_unit:
                hist = by_source.setdefault(r.source, {})
                hist[r.bin] = hist.get(r.bin, 0) + r.n
                default[r.source] = r.note_unit or r.common_unit
        for s, hist in by_source.items():
            bins = sorted(hist)
            count = np.array([hist[b] for b in bins], float)
            like = np.array([[math.exp(-0.5 * ((common_log(b, c) - mean) / sd) ** 2) + FAR for c in codes] for b in bins])
            prior = np.array([NOTE_SHARE if c == default[s] else (1 - NOTE_SHARE) / max(1, len(codes) - 1) for c in codes])
            alpha = prior * NOTE_ROWS
            w = prior
            for _ in range(rounds):
                post = like * w
                post /= post.sum(1, keepdims=True)
                w = (count[:, None] * post).sum(0) + alpha
                w /= w.sum()
            post = like * w
            post /= post.sum(1, keepdims=True)
            out += [(key, s, int(b), c, float(p)) for b, row in zip(bins, post, strict=True) for c, p in zip(codes, row, strict=True)]
    return out


def convert_to_common(spark: SparkSession, data_dir: str, trust_notes: bool = False) -> DataFrame:
    """(spec_id, document_id, spec_key, value, unit_code, common_unit, common_value, origin, posterior, uncertain, extracted_at).

    One row per readable delivered quantity; origin is 'written', 'model', 'note' or 'registry'.
    Null, NaN, infinite and unreadable values give no row; zero and negative values have no logarithm
    and get the documented unit without a posterior; an empty table gives no rows.
    """
    registry = Registry.load(spark, data_dir)
    notes, sources = note_units(read_table(spark, data_dir, "doc_source"), registry)
    specs = read_table(spark, data_dir, "document_spec", "document_id")
    rows = of_live_documents(quantities(spark, data_dir, registry), read_table(spark, data_dir, "search_document", "id", "source"), "source", hot=hot_documents(specs))
    rows = cut(rows.withColumn("note_unit", lookup(notes, F.concat("source", F.lit("|"), "quantity"))))
    best: dict[tuple[str, str, int], list[tuple[float, str]]] = {}
    for k, s, b, c, p in fit_units(rows, registry, sources):
        best.setdefault((k, s, b), []).append((p, c))
    table = local_table(
        spark, [(*k, max(v)[1], c, p) for k, v in best.items() for p, c in v], _k="string", _s="string", _b="int32", model_unit="string", _c="string", posterior="double"
    )
    documented = F.coalesce("note_unit", "common_unit")
    free = F.col("written_unit").isNull() & (F.col("value") > 0)
    known = F.when(F.col("source").isin(*sources), F.col("source")).otherwise(F.lit(""))
    same = (F.col("spec_key") == F.col("_k")) & (known == F.col("_s")) & free & (_bin(F.when(free, F.col("value"))) == F.col("_b"))
    wanted = F.col("_c") == (documented if trust_notes else F.col("model_unit"))
    rows = rows.join(F.broadcast(table), same & wanted, "left")
    rows = rows.withColumn("unit_code", F.coalesce("written_unit", documented if trust_notes else F.coalesce("model_unit", documented)))
    posterior = F.when(F.col("written_unit").isNotNull(), F.lit(1.0)).otherwise(F.col("posterior"))
    origin = F.when(F.col("written_unit").isNotNull(), "written").when(F.lit(not trust_notes) & F.col("model_unit").isNotNull(), "model").when(F.col("note_unit").isNotNull(), "note").otherwise("registry")
    factor = lookup({c: float(u[1]) for c, u in registry.units.items()}, F.col("unit_code"))
    offset = lookup({c: float(u[2]) for c, u in registry.units.items()}, F.col("unit_code"))
    return rows.select(
        "spec_id", "document_id", "spec_key", "value", "unit_code", "common_unit", (F.col("value") * factor + offset).alias("common_value"),
        origin.alias("origin"), posterior.alias("posterior"), (F.coalesce(posterior, F.lit(0.0)) < CERTAIN).alias("uncertain"), "extracted_at",
    )


def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(spec_id, unit_code) of the readable quantities recorded in another unit than the common one."""
    return convert_to_common(spark, data_dir).where("unit_code <> common_unit").select("spec_id", "unit_code").distinct()


def p6_units_report(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per attribute, unit and origin: number of quantities, of uncertain ones, and the mean in the common unit."""
    rows = convert_to_common(spark, data_dir).dropDuplicates(["spec_id"])
    return rows.groupBy("spec_key", "unit_code", "origin").agg(
        F.count(F.lit(1)).alias("quantities"), F.count_if("uncertain").alias("uncertain"), F.round(F.avg("common_value"), 6).alias("mean_common")
    )
