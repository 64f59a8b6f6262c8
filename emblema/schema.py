"""Column layout of the register and of the smaller tables around it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import MARK_TYPES, STATUSES

_STRING = T.StringType()

REGISTER = T.StructType(
    [
        T.StructField("id", _STRING, False),
        T.StructField("application_number", _STRING),
        T.StructField("registration_number", _STRING),
        T.StructField("mark_name", _STRING),
        T.StructField("mark_type", _STRING),
        T.StructField("nice_classes", T.ArrayType(T.IntegerType())),
        T.StructField("goods_services", T.ArrayType(_STRING)),
        T.StructField("applicant_name", _STRING),
        T.StructField("applicant_country", _STRING),
        T.StructField("filing_date", _STRING),
        T.StructField("priority_date", _STRING),
        T.StructField("registration_date", _STRING),
        T.StructField("expiry_date", _STRING),
        T.StructField("status", _STRING),
        T.StructField("jurisdiction", _STRING),
        T.StructField("source", _STRING),
        T.StructField("languages", T.ArrayType(_STRING)),
        T.StructField("text_vector", T.ArrayType(T.FloatType())),
        T.StructField("image_vector", T.ArrayType(T.FloatType())),
        T.StructField("raw_url", _STRING),
        T.StructField("scraped_at", _STRING),
        T.StructField("updated_at", _STRING),
    ]
)

VECTOR_COLUMNS = ("text_vector", "image_vector")

# value of a text column that an incoming table does not carry; others are null
_DEFAULT_TEXT = {
    "mark_type": "word",
    "applicant_name": "",
    "applicant_country": "",
    "status": "application",
    "jurisdiction": "EU",
    "source": "euipo",
}


def default_value(name: str) -> Column:
    if name in ("nice_classes", "goods_services"):
        return F.array()
    if name == "languages":
        return F.array(F.lit("en"))
    return F.lit(_DEFAULT_TEXT.get(name))


def conform(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Give ``df`` the register's columns: cast what is there, fill defaults for what is not, keep ``carry``."""
    present = set(df.columns)
    columns = []
    for field in REGISTER:
        value = F.col(field.name) if field.name in present else default_value(field.name)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns, *carry)


def without_vectors(df: DataFrame) -> DataFrame:
    """Drop the vector columns before the action, so a columnar source never reads them."""
    return df.drop(*VECTOR_COLUMNS)


def domain_violation() -> Column:
    """Reason why a register row breaks a column domain, or null."""
    return (
        F.when(F.col("application_number").isNull() | (F.col("application_number") == ""), "missing application_number")
        .when(F.col("mark_name").isNull() | (F.col("mark_name") == ""), "missing mark_name")
        .when(~F.col("mark_type").isin(*MARK_TYPES), "unknown mark_type")
        .when(~F.col("status").isin(*STATUSES), "unknown status")
    )
