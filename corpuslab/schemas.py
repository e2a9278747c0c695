"""Declared schemas of the tables this library reads and writes."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

COMPLAINT_COLUMNS = (
    "Date received", "Product", "Sub-product", "Issue", "Sub-issue", "Consumer complaint narrative", "Company public response", "Company",
    "State", "ZIP code", "Tags", "Submitted via", "Date sent to company", "Company response to consumer", "Timely response?", "Complaint ID",
)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, t, True) for k, t in fields.items()])


RAW_COMPLAINTS = StructType([StructField(c, StringType(), True) for c in COMPLAINT_COLUMNS])
RUNS = _struct(
    experiment=StringType(), model=StringType(), seed=IntegerType(), macro_f1=DoubleType(), accuracy=DoubleType(), macro_precision=DoubleType(), macro_recall=DoubleType(),
    best_epoch=IntegerType(), epochs_run=IntegerType(), train_time=DoubleType(), parameter_count=LongType(), checkpoint_path=StringType(), dataset_version=StringType(), logged_at=TimestampType(),
)
#: The second registry, keyed by run_id. The columns of its file.
TRACKED_RUNS = _struct(
    run_id=StringType(), model_name=StringType(), seed=IntegerType(), train_loss=DoubleType(), val_loss=DoubleType(), val_accuracy=DoubleType(), best_val_macro_f1=DoubleType(),
    val_macro_precision=DoubleType(), val_macro_recall=DoubleType(), test_loss=DoubleType(), test_accuracy=DoubleType(), test_macro_f1=DoubleType(), test_macro_precision=DoubleType(),
    test_macro_recall=DoubleType(), best_epoch=IntegerType(), epochs_run=IntegerType(), training_time_s=DoubleType(), trainable_params=LongType(), total_params=LongType(),
    dataset_content_sha256=StringType(), git_commit=StringType(), timestamp_utc=StringType(),
)
PREDICTIONS = _struct(test_idx=LongType(), y_true=IntegerType(), y_pred=IntegerType())
EPOCHS = _struct(run=StringType(), epoch=IntegerType(), val_macro_f1=DoubleType(), loss=DoubleType(), accuracy=DoubleType(), learning_rate=DoubleType())
#: The keys of a checkpoint record.
CHECKPOINT = _struct(
    experiment=StringType(), seed=IntegerType(), best_epoch=IntegerType(), monitor_metric=StringType(), best_metric_value=DoubleType(), checkpoint_file=StringType(),
    model_architecture=MapType(StringType(), StringType()), created_at_utc=StringType(),
)
SPLIT = _struct(row_id=LongType(), split=StringType())
