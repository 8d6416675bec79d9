"""Vocabularies of the data model. They must be spelled as they are."""

VERSION_STATUS = ["PENDING", "RUNNING", "READY", "READY_DEGRADED", "FAILED"]
JOB_STATE = ["PENDING", "CLAIMED", "DONE", "FAILED"]
STAGES = ["parse", "chunk", "temporal", "embed", "publish"]
BLOCK_TYPE = ["HEADING", "PARAGRAPH", "LIST_ITEM", "TABLE_TEXT", "UNKNOWN_TEXT"]
PRECISION = ["DAY", "MONTH", "YEAR", "SEASON", "DECADE", "CENTURY", "RANGE", "UNKNOWN"]
CERTAINTY = ["EXACT", "APPROXIMATE", "UNCERTAIN"]
ORIGIN = ["SOURCE_METADATA", "CONTENT_MENTION"]
SERVED = ["READY", "READY_DEGRADED"]
MEDIA_TYPES = {".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".pdf": "application/pdf"}
UPLOAD_LIMIT = 10 * 1024 * 1024
