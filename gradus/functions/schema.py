"""Column roles of a postings table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSchema:
    """Which columns play which role; the defaults are the full 315 feature columns."""

    # The columns of the postings files.
    date: tuple[str, ...] = ("job_posted_date",)
    categorical: tuple[str, ...] = ("job_title", "feature_1", "job_state")
    boolean: tuple[str, ...] = tuple(f"feature_{i}" for i in (3, 4, 5, 6, 7, 8, 9, 11, 12))
    quantitative: tuple[str, ...] = ("feature_2", "feature_10")
    block: tuple[str, ...] = tuple(f"job_desc_{i:03d}" for i in range(1, 301))
    target: str = "salary_category"
    id: str = "id"
    #: block kept as one array column instead of many doubles
    packed: str | None = field(default=None)

    @property
    def features(self) -> list[str]:
        block = [self.packed] if self.packed else list(self.block)
        return [*self.date, *self.categorical, *self.boolean, *self.quantitative, *block]

    def struct(self, with_target: bool = True, with_id: bool = False) -> T.StructType:
        """Explicit read schema of the CSV files."""
        fields = [T.StructField(self.id, T.LongType())] if with_id else []
        fields += [T.StructField(c, T.StringType()) for c in (*self.date, *self.categorical)]
        fields += [T.StructField(c, T.IntegerType()) for c in self.boolean]
        fields += [T.StructField(c, T.DoubleType()) for c in (*self.quantitative, *self.block)]
        if with_target:
            fields.append(T.StructField(self.target, T.StringType()))
        return T.StructType(fields)


POSTINGS = FeatureSchema()
