"""What goes out with an answer: saved locators, and as many whole items as a reply may hold."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarrylight.schemas import FRAME_BYTES, MAX_LOCATOR_BYTES

# A saved path is never compared with the file of that name.
NOT_CHECKED, INVALID, OUTPUT_LIMIT = "not_checked", "invalid_locator", "output_limit"


def source_info(path):
    """status, saved_path_hint, reason, live_status: the path as it was saved, or why it can't be shown."""
    absolute = path.rlike(r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*:)?/") & ~path.contains("\0")
    reason = F.when(F.coalesce(~absolute, F.lit(True)), INVALID).when(F.octet_length(path) > MAX_LOCATOR_BYTES, OUTPUT_LIMIT)
    return F.struct(
        F.when(reason.isNull(), "available").otherwise("unavailable").alias("status"),
        F.when(reason.isNull(), path).alias("saved_path_hint"),
        reason.alias("reason"),
        F.lit(NOT_CHECKED).alias("live_status"),
    )


def size(value) -> int:
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=lambda b: bytes(b).hex()).encode())


def fitting(items: list[dict], limit: int = FRAME_BYTES, around: dict | None = None) -> int:
    """The number of first items that fit into `limit` bytes of JSON together with what is `around` them."""
    left = limit - size({"items": [], **around} if around else [])
    for n, item in enumerate(items):
        left -= size(item) + (n > 0)
        if left < 0:
            return n
    return len(items)


def without_locators(items: list[dict]) -> list[dict]:
    """The items with every shown path left out for want of room."""
    gone = {"status": "unavailable", "saved_path_hint": None, "reason": OUTPUT_LIMIT, "live_status": NOT_CHECKED}
    return [{**i, "source_info": gone} if (i.get("source_info") or {}).get("status") == "available" else i for i in items]


def fit(answer: dict, limit: int = FRAME_BYTES, keep_items: bool = False) -> dict:
    """An answer (with items and stop) as it may go out: locators go first where items must stay (exact answers), then
    whole items from the end, and stop says so."""
    around = {k: v for k, v in answer.items() if k != "items"} | {"stop": OUTPUT_LIMIT}
    items = answer["items"]
    if keep_items and fitting(items, limit, around) < len(items):
        items = without_locators(items)
    n = fitting(items, limit, around)
    return {**answer, "items": items[:n], "stop": answer["stop"] if n == len(items) else OUTPUT_LIMIT}
