"""Clinical relations derived by Spark from the given tables.

Users of ``events`` play stays: their events, with time compressed eightfold and cut to minutes, become bedside
readings, laboratory results, outputs and pump readings. ``customer`` gives patients, ``orders`` infusion
orders, ``lineitem`` with ``part`` prescriptions, ``documents`` echo reports.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.catalog import codes
from bedside.functions.time import elapsed_days
from bedside.sources import sinks
from bedside.sources.readers import read_table
from bedside.sources.sinks import shared_folder

#: Folder and schema of what :meth:`Tables.once` wrote.
_WRITTEN: dict[tuple[str, str, str], tuple] = {}


@dataclass(frozen=True)
class Tables:
    """The given tables of one folder, scanned on demand."""

    spark: SparkSession
    folder: str

    def __getitem__(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder.rstrip('/')}/{name}.parquet")

    def scratch(self) -> str:
        """The folder all executors share."""
        return shared_folder(self.spark)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What ``build`` makes of this folder, written once per application: several queries read one training run."""
        known = (self.spark.sparkContext.applicationId, self.folder, name)
        if known not in _WRITTEN:
            frame = build()
            path = sinks.passing_folder(self.spark, f"{name}-{uuid.uuid4().hex}")
            sinks.materialize(frame, path)
            _WRITTEN[known] = path, frame.schema
        path, schema = _WRITTEN[known]
        return self.spark.read.schema(schema).parquet(path)

    def events(self) -> DataFrame:
        return self["events"]

    def readings(self) -> DataFrame:
        """Events with their property ``k`` and the compressed time ``moment``."""
        micros = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)"
        return self["events"].select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int").alias("k"),
            F.expr(f"timestampadd(MICROSECOND, ({micros} div 480000000) * 60000000, timestamp_ntz'2024-01-01')").alias(
                "moment"
            ),
        )

    def icustays(self) -> DataFrame:
        return (
            self.readings()
            .groupBy("user_id")
            .agg(F.min("moment").alias("intime"), F.max("moment").alias("outtime"))
            .select(
                (F.col("user_id") + 2000000).alias("subject_id"),
                (F.col("user_id") + 1000000).alias("hadm_id"),
                F.col("user_id").alias("icustay_id"),
                "intime",
                "outtime",
            )
        )

    def all_stays(self) -> DataFrame:
        """Every customer as a stay; those without events stay for four days."""
        seen = self.icustays().select("icustay_id", "intime", "outtime")
        people = self["customer"].select(F.col("c_custkey").alias("icustay_id"))
        return people.join(seen, "icustay_id", "left").select(
            (F.col("icustay_id") + 2000000).alias("subject_id"),
            (F.col("icustay_id") + 1000000).alias("hadm_id"),
            "icustay_id",
            F.coalesce("intime", F.lit("2024-01-01").cast("timestamp_ntz")).alias("intime"),
            F.coalesce("outtime", F.lit("2024-01-05").cast("timestamp_ntz")).alias("outtime"),
        )

    def icustay_detail(self) -> DataFrame:
        person = self["customer"].select(
            F.col("c_custkey").alias("icustay_id"),
            F.when(F.col("c_mktsegment") < "F", "M").otherwise("F").alias("gender"),
            F.floor(F.abs("c_acctbal") * 3 / 365).cast("double").alias("age"),
            (F.col("c_acctbal") < 0).cast("int").alias("hospital_expire_flag"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "N").otherwise("Y").alias("first_icu_stay"),
        )
        return (
            self.icustays()
            .join(person, "icustay_id", "inner")
            .withColumn("los_icu", elapsed_days("intime", "outtime"))
            .withColumn("first_hosp_stay", F.lit("Y"))
        )

    def patients(self) -> DataFrame:
        return self["customer"].select(
            (F.col("c_custkey") + 2000000).alias("subject_id"),
            F.date_sub(F.lit("2024-01-01").cast("date"), (F.floor(F.abs("c_acctbal")) * 3).cast("int"))
            .cast("timestamp_ntz")
            .alias("dob"),
        )

    def admissions(self) -> DataFrame:
        return self["customer"].select((F.col("c_custkey") + 1000000).alias("hadm_id"))

    def chartevents(self) -> DataFrame:
        rows = self.readings().withColumn("itemid", _code(codes.CHART))
        gcs = F.col("itemid").isin(454, 223901, 723, 223900, 184, 220739)
        click, view = F.col("event_type") == "click", F.col("event_type") == "view"
        return rows.select(
            (F.col("user_id") + 2000000).alias("subject_id"),
            F.col("user_id").alias("icustay_id"),
            "itemid",
            F.col("moment").alias("charttime"),
            F.when((F.col("itemid") == 723) & click, "1.0 ET/Trach")
            .when((F.col("itemid") == 223900) & click, "No Response-ETT")
            .when(F.col("itemid").isin(467, 469, 226732) & click, "CPAP Mask")
            .when(F.col("itemid").isin(467, 469, 226732) & view, "Bipap mask [Left]")
            .otherwise(F.col("event_type"))
            .alias("value"),
            F.when((F.col("event_type") == "error") & (F.col("k") > 90), F.lit(None).cast("double"))
            .when(gcs, F.least(F.lit(6.0), F.floor(F.col("value") / 20) + 1.0))
            .otherwise(F.col("value"))
            .alias("valuenum"),
            F.when((F.col("event_type") == "purchase") & F.col("k").between(30, 40), 1).when(view, 0).alias("error"),
        )

    def labevents(self) -> DataFrame:
        return self.readings().select(
            (F.col("user_id") + 2000000).alias("subject_id"),
            (F.col("user_id") + 1000000).alias("hadm_id"),
            _code(codes.LABS).alias("itemid"),
            F.col("moment").alias("charttime"),
            F.col("event_type").alias("value"),
            (F.col("value") / 10 - 0.5).alias("valuenum"),
        )

    def outputevents(self) -> DataFrame:
        kind = F.col("event_type")
        return self.readings().select(
            F.col("user_id").alias("icustay_id"),
            F.when((kind == "signup") & (F.col("k") < 2), 227488)
            .when(kind == "signup", 227489)
            .when(kind == "click", 40055)
            .when(kind == "view", 226559)
            .when(kind == "purchase", 40069)
            .otherwise(220050)
            .alias("itemid"),
            F.col("moment").alias("charttime"),
            (F.col("value") * F.when(F.col("k") > 97, 40).otherwise(2)).alias("value"),
        )

    def inputevents_cv(self) -> DataFrame:
        kind = F.col("event_type")
        rate = F.when(kind == "view", F.lit(None).cast("double")).when(kind == "click", 0.0).otherwise(F.col("value"))
        rows = self.readings().withColumn("itemid", _code(codes.VASOPRESSORS))
        swapped = F.col("itemid") == 42273
        return rows.select(
            (F.col("user_id") + 2000000).alias("subject_id"),
            (F.col("user_id") + 1000000).alias("hadm_id"),
            F.col("user_id").alias("icustay_id"),
            F.col("moment").alias("charttime"),
            "itemid",
            F.when(swapped, F.col("k").cast("double")).otherwise(rate).alias("rate"),
            F.when(swapped, rate).otherwise(F.col("k").cast("double")).alias("amount"),
            F.lit("mg").alias("amountuom"),
            F.when((kind == "error") & (F.col("k") < 50), "Stopped").when(kind == "error", "D/C'd").alias("stopped"),
        )

    def inputevents_mv(self) -> DataFrame:
        minutes = F.floor(F.col("o_totalprice") / 20).cast("long")
        return self["orders"].select(
            (F.col("o_custkey") + 2000000).alias("subject_id"),
            (F.col("o_custkey") + 1000000).alias("hadm_id"),
            F.col("o_custkey").alias("icustay_id"),
            F.floor(F.col("o_orderkey") / 4).alias("linkorderid"),
            F.when(F.col("o_orderpriority") < "2", 221906)
            .when(F.col("o_orderpriority") < "3", 221794)
            .when(F.col("o_orderpriority") < "4", 228340)
            .otherwise(222315)
            .alias("itemid"),
            F.col("o_orderdate").alias("starttime"),
            F.timestamp_add("MINUTE", minutes, "o_orderdate").alias("endtime"),
            F.floor(F.col("o_totalprice") / 2000).cast("double").alias("amount"),
            F.lit("mg").alias("amountuom"),
            F.when(F.col("o_orderstatus") == "P", "Rewritten").otherwise("FinishedRunning").alias("statusdescription"),
        )

    def drug_inputs_cv(self) -> DataFrame:
        """Diuretic pump readings by supplier and ship date."""
        return self["lineitem"].filter(F.col("l_returnflag") == "A").select(
            (F.col("l_suppkey") + 2000000).alias("subject_id"),
            (F.col("l_suppkey") + 1000000).alias("hadm_id"),
            F.col("l_suppkey").alias("icustay_id"),
            F.col("l_shipdate").alias("charttime"),
            F.when(F.col("l_linenumber") < 3, 45275).when(F.col("l_linenumber") < 6, 30123).otherwise(30047).alias(
                "itemid"
            ),
            F.lit(None).cast("double").alias("rate"),
            F.when(F.col("l_quantity") < 45, F.col("l_quantity")).alias("amount"),
            F.lit("mg").alias("amountuom"),
            F.lit(None).cast("string").alias("stopped"),
        )

    def prescriptions(self) -> DataFrame:
        name = F.col("p_name")
        joined = self["lineitem"].filter(F.col("l_returnflag") != "A").join(
            self["part"].select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "inner"
        )
        dose = F.floor("l_quantity").cast("int").cast("string")
        return joined.select(
            (F.col("l_suppkey") + 2000000).alias("subject_id"),
            (F.col("l_suppkey") + 1000000).alias("hadm_id"),
            F.when(name.endswith("ring"), "Furosemide 20mg/2mL")
            .when(name.endswith("plate"), "TORSEMIDE")
            .when(name.endswith("bolt"), "Bumetanide")
            .when(name.endswith("gear"), "Ethacrynic Acid")
            .when(name.endswith("rod"), "Lasix")
            .when(name.endswith("gizmo"), "torasemide")
            .otherwise(name)
            .alias("drug"),
            F.col("l_shipdate").alias("startdate"),
            F.when(F.col("l_linenumber") == 7, F.concat(dose, F.lit("-"), dose))
            .when((F.col("l_linenumber") == 6) & (F.col("l_quantity") > 45), F.lit(None).cast("string"))
            .when((F.col("l_linenumber") == 6) & (F.col("l_quantity") < 5), F.lit("J20"))
            .when(F.col("l_linenumber") == 5, F.concat(dose, F.lit("0")))
            .otherwise(dose)
            .alias("dose_val_rx"),
            F.lit("mg").alias("dose_unit_rx"),
            F.when(F.col("l_linestatus") == "O", "IV DRIP")
            .when(F.col("l_linenumber") < 3, "PO/NG")
            .when(F.col("l_linenumber") < 4, "Per G Tube")
            .otherwise("SC")
            .alias("route"),
        )

    def noteevents(self) -> DataFrame:
        """Documents with an echo report head; French ones carry de-identified numbers and no time."""
        n = F.col("n_chars").cast("string")
        hidden = F.col("lang") == "fr"
        clock = F.when(
            ~hidden,
            F.concat(
                F.lit("Date/Time: [**2101-1-1**] at "),
                F.pmod("n_chars", F.lit(24)).cast("string"),
                F.lit(":"),
                F.lpad(F.pmod("doc_id", F.lit(60)).cast("string"), 2, "0"),
                F.lit("\n"),
            ),
        ).otherwise("")
        report = F.concat(
            clock,
            F.lit("Indication: "), F.col("source"), F.lit(" check\n"),
            F.lit("Height: (in) "), F.when(hidden, F.lit("[** 60 **]")).otherwise(n), F.lit("\n"),
            F.lit("Weight (lb): "), n, F.lit(".5\n"),
            F.lit("BSA (m2): "), F.when(hidden, F.lit("*")).otherwise(F.lit("1.75")), F.lit(" m2\n"),
            F.lit("BP (mm Hg): "), n, F.lit("/80\n"),
            F.when(F.col("lang") == "en", F.lit("HR (bpm): 72\n")).otherwise(F.lit("HR (bpm): unknown\n")),
            F.lit("Status: Inpatient\r\n"),
            F.lit("Test: TTE (Complete)\n"),
            F.lit("Doppler: \n"),
            F.lit("Technical Quality: Adequate\n"),
            F.col("text"),
        )
        return self["documents"].select(
            F.col("doc_id").alias("row_id"),
            (F.col("doc_id") + 2000000).alias("subject_id"),
            (F.col("doc_id") + 1000000).alias("hadm_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(28)).cast("int")).alias("chartdate"),
            F.when(F.col("lang") == "de", "Nursing").otherwise("Echo").alias("category"),
            report.alias("text"),
        )

    def first_day(self) -> DataFrame:
        """Per-stay summary inputs of the severity score, from the first day's readings."""
        rows = self.readings().withColumnRenamed("user_id", "icustay_id")
        spine = self.icustays().select("icustay_id", "intime")
        day = rows.join(spine, "icustay_id", "inner").filter(F.col("moment") <= F.col("intime") + F.expr("INTERVAL 24 HOURS"))
        spread = {
            "heartrate": ("click", "value + 40"), "sysbp": ("view", "value * 2"), "resprate": ("error", "value / 2"),
            "tempc": ("purchase", "30 + value / 8"), "vital_glucose": ("signup", "value / 4"),
            "glucose": ("error", "value / 4"), "bun": ("click", "value / 2"), "hematocrit": ("signup", "value / 1.5D"),
            "wbc": ("click", "value / 3"), "sodium": ("view", "100 + value"), "potassium": ("purchase", "2 + value / 20"),
            "bicarbonate": ("error", "value / 2"),
        }
        columns = []
        for name, (kind, sql) in spread.items():
            v = F.expr(f"CASE WHEN event_type = '{kind}' THEN {sql} END")
            columns += [F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]
        return day.groupBy("icustay_id").agg(
            *columns,
            (F.floor(F.min(F.expr("CASE WHEN event_type = 'signup' THEN value END")) / 5) + 2.0).alias("mingcs"),
            F.sum(F.expr("CASE WHEN event_type = 'view' THEN value * 10 END")).alias("urineoutput"),
            F.max(F.expr("CASE WHEN k > 90 THEN 1 WHEN k > 50 THEN 0 END")).alias("mechvent"),
        )


def _code(numbers: list[int]):
    """The ``k``-th of a hundred codes."""
    return F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("k") + 1)
