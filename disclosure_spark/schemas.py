"""Explicit schemas of every table the jobs read or write (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_LONG, _INT, _DBL, _STR, _DATE = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType()

FILING_SUMMARIES_RAW = _struct(("CIK", _LONG), ("FILING_DATE", _STR), ("FORM_TYPE", _STR), ("FILE_NAME", _STR))
FILING_SUMMARIES = _struct(("cik", _LONG), ("filing_date", _DATE), ("form_type", _STR), ("file_name", _STR))
MEMBERSHIP = _struct(("snapshot_date", _DATE), ("cik", _LONG))
CIK_MAP_RAW = _struct(("CIK", _LONG), ("Ticker", _STR), ("Name", _STR))
REPORT_INDEX_RAW = _struct(
    ("CIK", _LONG), ("Ticker", _STR), ("Company", _STR), ("Filing_Date", _STR), ("Form_Type", _STR), ("File_Path", _STR)
)
REPORT_INDEX = _struct(
    ("report_id", _LONG), ("cik", _LONG), ("ticker", _STR), ("company", _STR), ("filing_date", _DATE), ("form_type", _STR)
)
LABELLED_INDEX_RAW = _struct(
    ("CIK", _LONG), ("Ticker", _STR), ("Company", _STR), ("Filing_Date", _STR), ("Form_Type", _STR),
    ("Change_Ratio", _DBL), ("Change_Nominal", _STR), ("File_Path", _STR),
)
LABELLED_INDEX = T.StructType(
    REPORT_INDEX.fields + _struct(("change_ratio", _DBL), ("change_nominal", _STR)).fields
)
COMPANY = _struct(("ticker", _STR), ("cik", _STR), ("name", _STR))
TRADING_DAY = _struct(("date", _DATE), ("ticker", _STR), ("open", _DBL), ("close", _DBL))
LOAD_ERRORS = _struct(("ticker", _STR), ("error_code", _INT), ("error_message", _STR), ("reason", _STR))
SENTENCES = _struct(("report_id", _LONG), ("pos", _INT), ("sentence", _STR))
CHUNKS = _struct(("report_id", _LONG), ("chunk", _INT), ("text", _STR))
SEQUENCE_FEATURES = _struct(("report_id", _LONG), ("step", _INT), ("embedding", T.ArrayType(_DBL)))
REPORT_FEATURES = T.StructType(LABELLED_INDEX.fields + _struct(("features", T.ArrayType(_DBL))).fields)
FINETUNE_SET = _struct(("split", _STR), ("label", _INT), ("sequence", _STR))
MLM_INSTANCE = _struct(
    ("report_id", _LONG), ("seq_id", _INT), ("dup", _INT), ("tokens", T.ArrayType(_STR)),
    ("masked_positions", T.ArrayType(_INT)), ("masked_labels", T.ArrayType(_STR)),
)
CURVE = _struct(("x", _DBL), ("train_mean", _DBL), ("train_std", _DBL), ("valid_mean", _DBL), ("valid_std", _DBL))
ROC = _struct(("fpr", _DBL), ("tpr", _DBL), ("threshold", _DBL))

#: One day of the vendor's daily series; only two of its fields are kept.
DAILY_POINT = _struct(("1. open", _STR), ("4. close", _STR))
DAILY_PAYLOAD = T.StructType([
    T.StructField("Time Series (Daily)", T.MapType(_STR, DAILY_POINT), True),
    T.StructField("Error Message", _STR, True),
    T.StructField("Note", _STR, True),
])
