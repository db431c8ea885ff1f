"""Journal inputs bound to the sales tables: deterministic, and expressible in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import micros


class Journal:
    """The raw inputs of the pipeline as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # a longer method is never compiled by HotSpot but interpreted, many times slower: such a stage runs in shorter ones
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        self.spark, self.sf_dir = spark, sf_dir
        self.written: DataFrame | None = None  # the whole journal as a table, once it is written

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def item_journey(self) -> DataFrame:
        """One maintenance line for each order line."""
        if self.written is not None:
            return self.written
        line, order = self.table("lineitem"), self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        buyer = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        nation = self.table("nation").select("n_nationkey", "n_name")
        part = self.table("part").select("p_partkey", "p_brand", "p_type")
        w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
        numbered = line.withColumn("_n", F.row_number().over(w))
        rows = numbered.join(part, F.col("l_partkey") == F.col("p_partkey")).join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(buyer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        seven = F.lpad(F.col("l_partkey").cast("string"), 7, "0")
        typo = lambda x: F.when(F.col("c_custkey") % 10 == 0, F.concat(F.substring(x, 1, 1), F.lit("X"), F.substring(x, 3, 100))).otherwise(x)
        recon = (F.col("o_orderpriority") == "5-LOW") & (F.col("l_orderkey") % 10 == 0)
        kind = F.col("l_linenumber") % 3
        status = (
            F.when(F.col("l_returnflag") == "R", "dismantled")
            .when(F.col("l_returnflag") == "A", " Installed")
            .when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") % 4 == 0, "UNREPAIRABLE").otherwise("REPAIRED"))
            .otherwise("DELIVERY")
        )
        return rows.select(
            (F.col("l_partkey") * 100000 + F.col("_n")).alias("journey_id"),
            F.when(F.col("l_partkey") % 50 == 0, "TERMINAL").otherwise("PART").alias("item_category"),
            F.col("p_type").alias("item_type"),
            F.when(F.col("l_partkey") % 211 != 0, F.col("p_brand")).alias("item_model_code"),
            F.when(F.col("l_partkey") % 97 != 0, seven).alias("item_pairing_code"),
            F.concat(F.col("p_brand"), F.lit("-"), seven, F.lit("-1")).alias("host_serial_code"),
            typo(F.col("c_mktsegment")).alias("client"),
            F.concat(F.lit("STASIUN "), typo(F.col("n_name"))).alias("place"),
            F.when(F.col("l_linestatus") == "F", "corrective").otherwise("PREVENTIVE").alias("wo_type"),
            F.col("l_orderkey").cast("string").alias("wo_code"),
            F.when(recon & (kind == 0), "RECON").alias("activity"),
            status.alias("status"),
            F.when(recon & (kind == 1), "recon team").alias("done_by"),
            F.when(recon & (kind == 2), "by recon").alias("remark"),
            micros(F.col("l_shipdate")).alias("created_us"),
        )

    def item(self) -> DataFrame:
        """Inventory: one row a part, a conflicting model for every 17th."""
        part = self.table("part")
        seven = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
        row = lambda model, k: part.select((F.col("p_partkey") * 10 + k).alias("item_id"), seven.alias("item_pairing_code"), F.concat(F.lit("SN"), F.col("p_partkey").cast("string")).alias("sn_ref"), model.alias("item_model_code"), F.lit("1").alias("repair_seq"))
        model = F.when(F.col("p_partkey") % 211 != 0, F.col("p_brand"))
        return row(model, 1).unionByName(row(F.lit("Other#1"), 2).where("item_id % 10 = 2 AND (item_id - 2) / 10 % 17 = 0"))

    def work_order(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("wo_id"), F.col("o_orderkey").cast("string").alias("wo_code"), F.when(F.col("o_orderkey") % 400 == 0, "recon").otherwise(F.col("o_orderpriority")).alias("work_type_code"))

    def work_type(self) -> DataFrame:
        """Codes are the first digit of a priority, names its text; RECON is a type of its own."""
        p = self.table("orders").select("o_orderpriority").distinct()
        return p.select(F.substring("o_orderpriority", 1, 1).alias("work_type_code"), F.col("o_orderpriority").alias("work_type")).unionByName(self.spark.createDataFrame([("R", "RECON")], "work_type_code string, work_type string"))

    def clients(self) -> DataFrame:
        return self.table("customer").select(F.substring("c_mktsegment", 1, 3).alias("code"), F.col("c_mktsegment").alias("name")).distinct()

    def places(self) -> DataFrame:
        return self.table("nation").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("code"), F.concat(F.lit("STASIUN "), F.col("n_name")).alias("name")).distinct()

    def request_out(self) -> DataFrame:
        """Issue requests for two of three install lines, 5 days before or after the install."""
        j = self.item_journey().where("status = ' Installed' AND journey_id % 3 <> 0")
        parent = F.lpad((F.pmod(F.col("journey_id"), F.lit(40)) * 50).cast("string"), 7, "0")
        return j.select(
            F.col("journey_id").alias("item_item_request_id"),
            F.col("host_serial_code").alias("item_serial_code_out"),
            "wo_code",
            F.when(F.col("journey_id") % 7 != 0, F.concat(F.when(F.col("journey_id") % 5 == 0, "Nowhere").otherwise("Terminal"), F.lit("-"), parent, F.lit("-1"))).alias("parent_serial_code"),
            (F.col("created_us") + F.when(F.col("journey_id") % 2 == 0, -5).otherwise(5) * 86_400_000_000).alias("recorded_us"),
        ).withColumnRenamed("item_item_request_id", "item_request_out_id")

    def item_model(self) -> DataFrame:
        part = self.table("part").select(F.col("p_brand").alias("item_model_code"), F.lit("PART").alias("item_category"), F.lit("part").alias("item_type"), F.concat(F.lit("Model "), F.col("p_brand")).alias("item_model_name")).distinct()
        own = self.spark.createDataFrame([("TERMINAL", "TERMINAL", "Gate", "Gate reader")], part.schema)
        return part.unionByName(own)
