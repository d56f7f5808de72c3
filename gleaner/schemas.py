"""Explicit schemas of the tables that operators read and write; nothing is inferred."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType)


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


S, L, I, D, B = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType()  # noqa: E741

METADATA = _schema(relative_path=S, split=S, **{"class": S}, extension=S, width=I, height=I, mode=S, channels=I, format=S, file_size_bytes=L, sha256=S, valid=B, error=S)
MANIFEST = _schema(relative_path=S, label_name=S, label_id=I, source_split=S, processed_split=S, sha256=S)
DEDUPLICATION = _schema(sha256=S, kept_relative_path=S, removed_relative_path=S, label_name=S)
TEST_DUPLICATES = _schema(group_id=I, sha256=S, relative_path=S, label_name=S, is_representative=S, group_size=I)
PREDICTIONS = _schema(filepath=S, true_label_id=I, true_label_name=S, predicted_label_id=I, predicted_label_name=S, confidence=D)
HISTORY = _schema(epoch=I, accuracy=D, loss=D, val_accuracy=D, val_loss=D, learning_rate=D)
PROBABILITIES = ArrayType(D)
