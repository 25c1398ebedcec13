"""The feature store's queries over one long table of features and the samples' own table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FEATURES
from .graph import keep_first

ORDER = ["sample_ix", "pos"]


@dataclass(frozen=True)
class FeatureSet:
    """features: a row for each feature of a sample; samples(sample, sample_ix): also those without any."""

    features: DataFrame
    samples: DataFrame

    @staticmethod
    def of(features: DataFrame, samples: DataFrame | None = None) -> FeatureSet:
        return FeatureSet(features, features.select("sample", "sample_ix").distinct() if samples is None else samples)

    @staticmethod
    def of_mapping(spark: SparkSession, data: dict[str, dict[str, dict]]) -> FeatureSet:
        """From {sample: {feature: {value, mapping, role, ...}}}, in that order."""
        rows = []
        for six, (sample, features) in enumerate(data.items()):
            for pos, (fid, f) in enumerate(features.items()):
                extra = {k: str(v) for k, v in f.items() if k not in ("value", "mapping", "role")}
                value = f.get("value")
                rows.append((sample, six, pos, fid, f.get("mapping", "none"), f.get("role"), None if value is None else float(value), extra or None))
        samples = spark.createDataFrame([(s, i) for i, s in enumerate(data)], "sample string, sample_ix long")
        return FeatureSet(spark.createDataFrame(rows, FEATURES), samples)

    # --- samples

    def filter_samples(self, condition: Column) -> FeatureSet:
        """Samples by a predicate on their own columns; their features go with them."""
        kept = self.samples.filter(condition)
        return FeatureSet(self.features.join(kept.select("sample"), "sample", "left_semi"), kept)

    def sample(self, which: int | str) -> FeatureSet:
        """One sample by index or name; an error if there is none."""
        picked = self.filter_samples(F.col("sample_ix") == which if isinstance(which, int) else F.col("sample") == which)
        if picked.samples.isEmpty():
            raise KeyError(which)
        return picked

    def map_samples(self, name: Column) -> FeatureSet:
        return FeatureSet(self.features.withColumn("sample", name), self.samples.withColumn("sample", name))

    # --- features

    def filter(self, condition: Column) -> FeatureSet:
        """Features by a predicate, in every sample; samples that lose all stay."""
        return replace(self, features=self.features.filter(condition))

    def map(self, **columns: Column) -> FeatureSet:
        return replace(self, features=self.features.withColumns(columns))

    def pluck(self, what: Column | None = None) -> DataFrame:
        """The set of extracted values over all samples, by default of the ids."""
        return self.features.select((F.col("fid") if what is None else what).alias("value")).distinct()

    def unique(self, *keys: str) -> DataFrame:
        """Over all samples, the first feature of each key (by default the id)."""
        return keep_first(self.features, list(keys) or ["fid"], ORDER)

    def unique_by_sample(self, *keys: str) -> DataFrame:
        return keep_first(self.features, ["sample", *(keys or ("fid",))], ORDER)

    def counts(self) -> DataFrame:
        n = self.features.groupBy("sample").agg(F.count("*").alias("n"))
        return self.samples.join(n, "sample", "left").select("sample", "sample_ix", F.coalesce("n", F.lit(0)).alias("n_features"))

    def roles(self) -> DataFrame:
        """(fid, role): a vertex's one role over all samples, else "mixed"."""
        one = self.features.filter("mapping = 'vertex' AND role IS NOT NULL").groupBy("fid").agg(F.min("role").alias("lo"), F.max("role").alias("hi"))
        return one.select("fid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("role"))

    def add(self, rows: DataFrame) -> FeatureSet:
        """More features; an id that its sample has already is an error, as is one given twice."""
        every = self.features.unionByName(rows)
        twice = every.groupBy("sample", "fid").count().filter("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"a sample has a feature twice: {twice.first()}")
        return FeatureSet(every, self.samples.unionByName(rows.select("sample", "sample_ix").distinct()).distinct())

    def to_json(self) -> DataFrame:
        """(sample, features): a JSON list of each sample's features in their order. A sample's list is one row, as in a file."""
        item = F.struct("pos", F.to_json(F.struct("fid", "mapping", "role", "value", "extra")).alias("j"))
        lists = self.features.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]).alias("xs"))
        return self.samples.join(lists, "sample", "left").select("sample", "sample_ix", F.concat(F.lit("["), F.coalesce(F.array_join("xs", ","), F.lit("")), F.lit("]")).alias("features"))

    @staticmethod
    def from_json(rows: DataFrame) -> FeatureSet:
        item = T._parse_datatype_string("array<struct<fid:string,mapping:string,role:string,value:double,extra:map<string,string>>>")
        spread = rows.select("sample", "sample_ix", F.posexplode(F.from_json("features", item)).alias("pos", "x"))
        return FeatureSet(spread.select("sample", "sample_ix", F.col("pos").cast("long").alias("pos"), "x.*"), rows.select("sample", "sample_ix"))


def hash_folds(cells: DataFrame, keys: list[str], value: str, k: int, seed: int = 0) -> DataFrame:
    """Adds `fold` (0 to k-1, null for zero cells) to the cells of a matrix: non-zero cells are dealt to folds of like size by a
    seeded hash; in fold f, training hides those of fold f and validation all other non-zero ones, while zeros stay in both."""
    fold = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(k)).cast("int")
    return cells.withColumn("fold", F.when(F.coalesce(F.col(value) != 0, F.lit(False)), fold))


def ranked_folds(cells: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """As hash_folds, but dealing each first key's non-zero cells in turn, in the order of the keys: sizes differ by one at most."""
    rank = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:])) - 1
    full = F.coalesce(F.col(value) != 0, F.lit(False))
    return cells.filter(full).withColumn("fold", F.pmod(rank, F.lit(k)).cast("int")).unionByName(cells.filter(~full).withColumn("fold", F.lit(None).cast("int")))


def fold_masks(dealt: DataFrame, value: str, fold: int) -> DataFrame:
    """Adds `train` and `valid`, with NaN where a cell is hidden."""
    hidden = F.lit(float("nan"))
    mine = F.col("fold") == fold
    return dealt.withColumns({"train": F.when(F.coalesce(mine, F.lit(False)), hidden).otherwise(F.col(value)), "valid": F.when(F.coalesce(~mine, F.lit(False)), hidden).otherwise(F.col(value))})
