"""The code table: radio codes and what they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dispatchflow.config import CALLS, CountSpec
from dispatchflow.schemas import RADIO_CODE

# The radio codes and their descriptions.
RADIO_CODES = {
    "ABA": "Abated",
    "ADM": "Admonished",
    "ADV": "Advised",
    "ARR": "Arrest",
    "CAN": "Cancel",
    "CSA": "CPSA assignment",
    "22": "Cancel",
    "CIT": "Cited",
    "CRM": "Criminal Activation",
    "GOA": "Gone on Arrival",
    "HAN": "Handled",
    "NCR": "Non-Criminal",
    "ND": "No Disposition",
    "NOM": "No Merit",
    "PAS": "Premises Appears Secure",
    "REP": "Report",
    "SFD": "SFFD Medical Staff Engaged",
    "UTL": "Unable to Locate",
    "VAS": "Vehicle Appears Secure",
}


def _named_for_join(codes: DataFrame, spec: CountSpec) -> DataFrame:
    return codes.select("disposition_code", "description").withColumnRenamed("disposition_code", spec.code_col)


def radio_codes(spark: SparkSession, path: str, spec: CountSpec = CALLS) -> DataFrame:
    """Codes from JSON array files, the code under the name it has in the counts."""
    return _named_for_join(spark.read.json(path, schema=RADIO_CODE, multiLine=True), spec)


def builtin_codes(spark: SparkSession, spec: CountSpec = CALLS) -> DataFrame:
    """The known radio codes, for a job that is given no code file."""
    return _named_for_join(spark.createDataFrame(list(RADIO_CODES.items()), RADIO_CODE), spec)
