"""Edit commands found in a table of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.functions.text import strip

# --- Fixed values: command phrases and patterns ----------------------------
_ROW = r"(?:dòng|hàng|row)\s*(\d+)"
_TARGET = r"(?:\s+(?:cột\s+)?([\wÀ-ỹ]+))?\s*(?:thành|=)\s*([^\n\.,]+)"
REJECT = r"(?:bác bỏ|từ chối|hủy|reject)\s+" + _ROW
APPROVE = r"(?:duyệt|chấp nhận|đồng ý|approve)\s+" + _ROW
EDIT_VERB_FIRST = r"(?:sửa|đổi|chỉnh|cập nhật|thay)\s+" + _ROW + _TARGET
EDIT_ROW_FIRST = _ROW + r"(?:\s+(?:sửa|đổi|chỉnh|cập nhật))?" + _TARGET
BATCH_VERBS = (
    "thay đổi", "thay doi", "sửa", "sua", "chỉnh", "chinh", "đổi", "doi",
    "gán", "gan", "set", "cập nhật", "update",
)
BATCH_VALUE_WORDS = ("thành", "thanh", "=")
BATCH_COLUMN = r"(?:cột|truong|field)\s+([a-zA-Z0-9_\sÀ-ỹ]+?)(?:\s+thành|\s+=|\s+thanh|\s+sang|\s+là)"
BATCH_COLUMN_WORDS = (
    "math score", "reading score", "writing score", "salary", "department",
    "email", "name", "date", "toán", "toan", "đọc", "doc", "viết", "viet",
)
BATCH_VALUE = (
    r"(?:thành|thanh|=)\s*([0-9]+(?:\.[0-9]+)?|[^\n,]+?)"
    r"(?:\s+điểm|\s+cho\s+tôi|\s+tại\s+đây|\s*,\s*gửi|\s*$)"
)
BATCH_TAIL = r"(?:điểm|cho tôi|tại đây|file clean|giúp tôi|hộ tôi).*$"
MILLION_WORDS = ("triệu", "trieu")


def _any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def _millions(value: Column) -> Column:
    """``1.5 triệu`` becomes ``1500000``; other values stay."""
    number = F.regexp_replace(value, r"[^0-9\.]", "")
    amount = (number.try_cast("decimal(30,9)") * 1_000_000).cast("decimal(38,0)").cast("string")
    return F.when(_any(value, MILLION_WORDS) & (number != ""), F.coalesce(amount, value)).otherwise(value)


def _group(text: Column, pattern: str, i: int) -> Column:
    """Capture group ``i`` or null."""
    g = F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern) & (g != ""), g)


def extract_edit_commands(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add action, row_id, column and new_value; keep only commands.

    Single-row commands are tried before column-wide ones: a message that
    names a row never edits a whole column.
    """
    t = F.lower(strip(text))
    # `(?U)` lets \s and \w follow Unicode, as the phrases are Vietnamese.
    u = lambda p: "(?U)" + p
    first, second = u(EDIT_VERB_FIRST), u(EDIT_ROW_FIRST)
    spoken = _group(t, u(BATCH_COLUMN), 1)
    listed = F.coalesce(*[F.when(t.contains(w), F.lit(w)) for w in BATCH_COLUMN_WORDS])
    batch = _any(t, BATCH_VERBS) & _any(t, BATCH_VALUE_WORDS) & t.rlike(u(BATCH_VALUE))
    batch_value = strip(F.regexp_replace(strip(F.regexp_extract(t, u(BATCH_VALUE), 1)), BATCH_TAIL, ""))

    def command(action, row, column, value):
        return F.struct(
            F.lit(action).alias("action"), row.cast("bigint").alias("row_id"),
            column.cast("string").alias("column"), value.cast("string").alias("new_value"))

    none = F.lit(None)
    cmd = (
        F.when(t.rlike(u(REJECT)), command("REJECT", F.regexp_extract(t, u(REJECT), 1), none, none))
        .when(t.rlike(u(APPROVE)), command("APPROVE", F.regexp_extract(t, u(APPROVE), 1), none, none))
    )
    for p in (first, second):
        cmd = cmd.when(t.rlike(p), command(
            "EDIT", F.regexp_extract(t, p, 1), _group(t, p, 2),
            _millions(strip(F.regexp_extract(t, p, 3)))))
    cmd = cmd.when(batch, command(
        "BATCH_EDIT", none, F.coalesce(strip(spoken), listed), _millions(batch_value)))
    return (
        messages.withColumn("_cmd", cmd).where(F.col("_cmd").isNotNull())
        .select("*", "_cmd.*").drop("_cmd")
    )
