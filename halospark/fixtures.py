"""The domain tables as views of the star-schema test tables, in Spark and (for the checks) as DuckDB SQL.

Years of shipping are snapshots, parts are particles, suppliers are halos, customers are galaxies of the
mass-function queries, events are wind-track records.  Masses and rates are whole numbers, so sums are exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .functions.physics import log10_or_null
from .plans.history import Simulation

STAR_ID_SHIFT = 1_000_000_000
N_SNAPS = 7
LAST_SNAP = N_SNAPS - 1
TARGET = 2


def _hundredths(rate: Column) -> Column:
    """A rate as a whole number of hundredths: sums and products of these are exact."""
    return F.round(rate * 100)


@dataclass(frozen=True)
class Fixtures:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _lineitem(self) -> DataFrame:
        return self.table("lineitem").withColumn("snapnum", F.year("l_shipdate") - 1995)

    @cached_property
    def timegrid(self) -> DataFrame:
        return (
            self._lineitem.select("snapnum")
            .distinct()
            .select(
                "snapnum",
                ((F.col("snapnum") + 1).cast("double") / N_SNAPS).alias("a"),
                (float(N_SNAPS) / (F.col("snapnum") + 1) - 1).alias("zred"),
            )
        )

    @cached_property
    def particles(self) -> DataFrame:
        """Gas: one row per (snapnum, PId)."""
        q = F.sum("l_quantity")
        return (
            self._lineitem.groupBy("snapnum", F.col("l_partkey").alias("PId"))
            .agg(
                F.when(F.max("l_tax") < 0.055, 0).otherwise(F.min("l_suppkey") + 1).cast("int").alias("haloId"),
                q.alias("Mass"),
                F.when(F.max("l_returnflag") == "R", 0.0).otherwise(q).alias("Sfr"),
                (3.0 + 0.5 * _hundredths(F.max("l_discount"))).alias("logT"),
                _hundredths(F.max("l_discount")).alias("Zmet"),
                F.when(F.min("l_linestatus") == "O", 1.0).otherwise(0.0).alias("Mc"),
                F.max("l_linenumber").cast("double").alias("Mwind"),
            )
            .withColumn("galId", F.col("haloId"))
        )

    @cached_property
    def stars(self) -> DataFrame:
        """Stars: ids of their own, also one row per (snapnum, PId)."""
        return (
            self._lineitem.where("l_returnflag = 'A'")
            .groupBy("snapnum", (F.col("l_partkey") + STAR_ID_SHIFT).alias("PId"))
            .agg(
                F.when(F.max("l_tax") < 0.025, 0).otherwise(F.min("l_suppkey") + 1).cast("int").alias("haloId"),
                F.sum("l_quantity").alias("Mass"),
                (3.0 + 0.5 * _hundredths(F.max("l_discount"))).alias("logT"),
            )
            .withColumn("galId", F.col("haloId"))
        )

    @cached_property
    def points(self) -> DataFrame:
        """Row-level particles with positions and phase."""
        return self._lineitem.select(
            "snapnum",
            F.col("l_partkey").alias("PId"),
            (F.col("l_suppkey") + 1).cast("int").alias("haloId"),
            (F.col("l_extendedprice") / 5.0).alias("x"),
            (F.col("l_quantity") * 400.0).alias("y"),
            (_hundredths(F.col("l_discount")) * 2000.0).alias("z"),
            F.col("l_quantity").alias("Mass"),
            (3.0 + 0.5 * _hundredths(F.col("l_tax"))).alias("logT"),
            (F.col("l_extendedprice") / 15000.0 - 1.5).alias("logRho"),
            _hundredths(F.col("l_discount")).alias("O"),
            _hundredths(F.col("l_tax")).alias("C"),
            F.when(F.col("l_linestatus") == "O", F.col("l_tax") * 10).otherwise(0.0).alias("Mc"),
            F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("Sfr"),
        )

    @cached_property
    def hosts(self) -> DataFrame:
        """The lowest supplier of a nation hosts the nation's other suppliers, at every snapshot."""
        supplier = self.table("supplier")
        lowest = supplier.groupBy("s_nationkey").agg((F.min("s_suppkey") + 1).cast("int").alias("hostId"))
        return supplier.join(lowest, "s_nationkey").select(
            F.explode(F.sequence(F.lit(0), F.lit(LAST_SNAP))).alias("snapnum"),
            (F.col("s_suppkey") + 1).cast("int").alias("haloId"),
            "hostId",
        )

    @cached_property
    def halos(self) -> DataFrame:
        def place(factor: int) -> Column:
            return F.pmod(F.col("haloId") * factor, F.lit(20000)).cast("double")

        return (
            self.particles.where("haloId <> 0")
            .groupBy("snapnum", "haloId")
            .agg(F.sum("Mass").alias("Mvir"), F.sum("Mass").alias("Msub"), F.count("*").alias("Npart"))
            .withColumns(
                {
                    "Rvir": 2000.0 + F.col("Npart") * 10.0,
                    "x": place(1999),
                    "y": place(4547),
                    "z": place(7919),
                }
            )
        )

    @cached_property
    def log_halos(self) -> DataFrame:
        return self.halos.select(
            "snapnum",
            "haloId",
            log10_or_null(F.col("Mvir") / C.HUBBLE).alias("logMvir"),
            log10_or_null(F.col("Msub") / C.HUBBLE).alias("logMsub"),
            "Rvir",
            "x",
            "y",
            "z",
        )

    @cached_property
    def galaxies(self) -> DataFrame:
        """One galaxy per customer with orders; logs put them into the range of real galaxies."""
        price = F.round("o_totalprice").cast("long")
        done = F.col("o_orderstatus") == "F"
        masses = (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("galId"))
            .agg(
                F.count("*").alias("Npart"),
                F.sum(price).alias("Mgal"),
                F.sum(F.when(done, price).otherwise(0)).alias("Mstar"),
                F.sum(F.when(done, 0).otherwise(price)).alias("Mgas"),
            )
        )
        return masses.withColumns(
            {
                "logMgal": log10_or_null(F.col("Mgal")) + 4.0,
                "logMsub": log10_or_null(F.col("Mgal")) + 5.6,
                "logMstar": log10_or_null(F.col("Mstar")) + 4.2,
                "x": F.pmod(F.col("Mgal"), F.lit(1000)) / 1000.0 - 0.5,
                "y": F.pmod(F.col("Mgal"), F.lit(997)) / 997.0 - 0.5,
                "z": F.pmod(F.col("Mgal"), F.lit(991)) / 991.0 - 0.5,
            }
        )

    @cached_property
    def snap_galaxies(self) -> DataFrame:
        """Galaxies per snapshot, from the gas."""
        return (
            self.particles.where("galId <> 0")
            .groupBy("snapnum", "galId")
            .agg(
                F.sum("Mass").alias("Mgal"),
                F.sum(F.when(F.col("Sfr") == 0, F.col("Mass")).otherwise(0.0)).alias("Mgas"),
                F.sum("Sfr").alias("Mstar"),
                F.sum("Sfr").alias("Sfr"),
            )
        )

    @cached_property
    def split(self) -> DataFrame:
        """Particle p was split off particle p div 4; parents are always older."""
        part = self.table("part")
        end = part.agg(F.max("p_partkey") + 1).scalar()
        events = part.select(
            F.col("p_partkey").alias("PId"),
            F.expr("p_partkey div 4").alias("parentId"),
            (F.col("p_partkey").cast("double") / end).alias("atime"),
            F.col("p_size").cast("double").alias("Mass"),
        )
        # the first particle has no parent
        return events.where("parentId <> PId")

    @cached_property
    def tracks(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("PhEWKey"), F.col("ts").alias("atime"), F.col("value").alias("Mass"), F.col("event_type").alias("tag")
        )

    @cached_property
    def launch(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("PhEWKey"),
            F.col("p_partkey").alias("PId"),
            F.col("p_size").cast("double").alias("Mass"),
            (F.col("p_size").cast("double") / 60.0).alias("atime"),
        )

    @cached_property
    def rejoin(self) -> DataFrame:
        return self.table("part").where("p_size <= 25").select(
            F.col("p_partkey").alias("PhEWKey"),
            F.floor(F.col("p_size") / 2.0).cast("double").alias("Mass"),
            (F.col("p_size").cast("double") / 60.0 + 0.25).alias("atime"),
        )

    @cached_property
    def iontab(self) -> DataFrame:
        """A 25 x 25 table of log fractions for two ions."""
        nation = self.table("nation").select(F.col("n_nationkey").alias("ih"))
        grid = nation.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(24))))
        return grid.withColumn("ion", F.explode(F.array(F.lit("HI"), F.lit("CIV"), F.lit("OVI"), F.lit("NeVIII"), F.lit("SiIV")))).select(
            "ion",
            "ih",
            "it",
            (-1.0 * (F.col("ih") + 2 * F.col("it") + F.length("ion")) / 10.0).alias("log_frac"),
        )

    @cached_property
    def tcosmic(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select(
            (n.cast("double") / 24).alias("a"), (13.5 * n * n / 576.0).alias("t")
        )

    @cached_property
    def simulation(self) -> Simulation:
        return Simulation(
            gas=self.particles,
            dark=self.particles,
            halos=self.log_halos,
            hosts=self.hosts,
            grid=self.timegrid,
            splits=self.split,
            launches=self.launch,
            rejoins=self.rejoin,
            n_snaps=N_SNAPS,
            stars=self.stars,
        )


# the same views for DuckDB
SQL = {
    "fx_timegrid": """SELECT DISTINCT CAST(year(l_shipdate) - 1995 AS INT) AS snapnum,
        CAST(year(l_shipdate) - 1994 AS DOUBLE) / 7 AS a, 7.0e0 / (year(l_shipdate) - 1994) - 1 AS zred FROM lineitem""",
    "fx_particles": """SELECT *, haloId AS galId FROM (
        SELECT CAST(year(l_shipdate) - 1995 AS INT) AS snapnum, l_partkey AS PId,
            CAST(CASE WHEN max(l_tax) < 0.055 THEN 0 ELSE min(l_suppkey) + 1 END AS INT) AS haloId,
            sum(l_quantity) AS Mass,
            CASE WHEN max(l_returnflag) = 'R' THEN 0.0e0 ELSE sum(l_quantity) END AS Sfr,
            3.0e0 + 0.5e0 * round(max(l_discount) * 100) AS logT, round(max(l_discount) * 100) AS Zmet,
            CASE WHEN min(l_linestatus) = 'O' THEN 1.0e0 ELSE 0.0e0 END AS Mc,
            CAST(max(l_linenumber) AS DOUBLE) AS Mwind
        FROM lineitem GROUP BY year(l_shipdate), l_partkey)""",
    "fx_stars": f"""SELECT *, haloId AS galId FROM (
        SELECT CAST(year(l_shipdate) - 1995 AS INT) AS snapnum, l_partkey + {STAR_ID_SHIFT} AS PId,
            CAST(CASE WHEN max(l_tax) < 0.025 THEN 0 ELSE min(l_suppkey) + 1 END AS INT) AS haloId,
            sum(l_quantity) AS Mass, 3.0e0 + 0.5e0 * round(max(l_discount) * 100) AS logT
        FROM lineitem WHERE l_returnflag = 'A' GROUP BY year(l_shipdate), l_partkey)""",
    "fx_points": """SELECT CAST(year(l_shipdate) - 1995 AS INT) AS snapnum, l_partkey AS PId,
        CAST(l_suppkey + 1 AS INT) AS haloId, l_extendedprice / 5.0e0 AS x, l_quantity * 400.0e0 AS y,
        round(l_discount * 100) * 2000.0e0 AS z, l_quantity AS Mass, 3.0e0 + 0.5e0 * round(l_tax * 100) AS logT,
        l_extendedprice / 15000.0e0 - 1.5e0 AS logRho, round(l_discount * 100) AS O, round(l_tax * 100) AS C,
        CASE WHEN l_linestatus = 'O' THEN l_tax * 10 ELSE 0.0e0 END AS Mc,
        CASE WHEN l_returnflag = 'R' THEN 0.0e0 ELSE l_quantity END AS Sfr
        FROM lineitem""",
    "fx_hosts": """SELECT CAST(t.range AS INT) AS snapnum, CAST(s.s_suppkey + 1 AS INT) AS haloId,
        CAST(min(s.s_suppkey) OVER (PARTITION BY t.range, s.s_nationkey) + 1 AS INT) AS hostId
        FROM supplier s, range(7) t""",
    "fx_halos": """SELECT snapnum, haloId, sum(Mass) AS Mvir, sum(Mass) AS Msub, CAST(count(*) AS BIGINT) AS Npart,
        2000.0e0 + count(*) * 10.0e0 AS Rvir, CAST((haloId * 1999) % 20000 AS DOUBLE) AS x,
        CAST((haloId * 4547) % 20000 AS DOUBLE) AS y, CAST((haloId * 7919) % 20000 AS DOUBLE) AS z
        FROM fx_particles WHERE haloId <> 0 GROUP BY snapnum, haloId""",
    "fx_log_halos": """SELECT snapnum, haloId, log10(Mvir / 0.7e0) AS logMvir, log10(Msub / 0.7e0) AS logMsub,
        Rvir, x, y, z FROM fx_halos""",
    "fx_galaxies": """SELECT *, CASE WHEN Mgal > 0 THEN log10(Mgal) END + 4.0e0 AS logMgal,
        CASE WHEN Mgal > 0 THEN log10(Mgal) END + 5.6e0 AS logMsub,
        CASE WHEN Mstar > 0 THEN log10(Mstar) END + 4.2e0 AS logMstar,
        (Mgal % 1000) / 1000.0e0 - 0.5e0 AS x, (Mgal % 997) / 997.0e0 - 0.5e0 AS y, (Mgal % 991) / 991.0e0 - 0.5e0 AS z
        FROM (SELECT o_custkey AS galId, CAST(count(*) AS BIGINT) AS Npart,
            CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS Mgal,
            CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS Mstar,
            CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(round(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS Mgas
            FROM orders GROUP BY o_custkey)""",
    "fx_snap_galaxies": """SELECT snapnum, galId, sum(Mass) AS Mgal,
        sum(CASE WHEN Sfr = 0 THEN Mass ELSE 0.0e0 END) AS Mgas, sum(Sfr) AS Mstar, sum(Sfr) AS Sfr
        FROM fx_particles WHERE galId <> 0 GROUP BY snapnum, galId""",
    "fx_split": """SELECT p_partkey AS PId, p_partkey // 4 AS parentId,
        CAST(p_partkey AS DOUBLE) / (SELECT max(p_partkey) + 1 FROM part) AS atime, CAST(p_size AS DOUBLE) AS Mass
        FROM part WHERE p_partkey // 4 <> p_partkey""",
    "fx_tracks": "SELECT user_id AS PhEWKey, ts AS atime, value AS Mass, event_type AS tag FROM events",
    "fx_launch": """SELECT p_partkey AS PhEWKey, p_partkey AS PId, CAST(p_size AS DOUBLE) AS Mass,
        CAST(p_size AS DOUBLE) / 60.0e0 AS atime FROM part""",
    "fx_rejoin": """SELECT p_partkey AS PhEWKey, CAST(floor(p_size / 2.0e0) AS DOUBLE) AS Mass,
        CAST(p_size AS DOUBLE) / 60.0e0 + 0.25e0 AS atime FROM part WHERE p_size <= 25""",
    "fx_iontab": """SELECT i.ion, a.n_nationkey AS ih, b.n_nationkey AS it,
        -1.0e0 * (a.n_nationkey + 2 * b.n_nationkey + length(i.ion)) / 10.0e0 AS log_frac
        FROM nation a, nation b, (VALUES ('HI'), ('CIV'), ('OVI'), ('NeVIII'), ('SiIV')) i(ion)""",
    "fx_tcosmic": "SELECT CAST(n_nationkey AS DOUBLE) / 24 AS a, 13.5e0 * n_nationkey * n_nationkey / 576.0e0 AS t FROM nation",
}


def with_views(body: str, ctes: dict[str, str]) -> str:
    """Prefix a SELECT with the common table expressions it uses, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                if ctes[name] is not text:
                    # a recursive expression names itself
                    visit(re.sub(rf"\b{name}\b", "", ctes[name]))
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body

    def defined(name: str) -> str:
        # worked out once however often it is named; one that names itself is so anyway
        kind = "" if re.search(rf"\b{name}\b", ctes[name]) else "MATERIALIZED "
        return f"{name} AS {kind}({ctes[name]})"

    return "WITH RECURSIVE " + ",\n".join(map(defined, needed)) + "\n" + body
