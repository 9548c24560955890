"""Table schemas and the domains of their string-valued columns."""

from __future__ import annotations

MARKER_STATUS = ("ACCEPTED", "REVIEW_REQUIRED", "UNRESOLVED", "DISCARDED", "REJECTED")
LIVE = ("ACCEPTED", "REVIEW_REQUIRED")
REVIEW_REASONS = (
    "NO_MATCH", "AMBIGUOUS", "INVALID_POSITION", "LOW_RECOGNITION_CONFIDENCE", "LANDMARKS_NOT_FOUND", "START_UNCERTAIN",
    "PREFIX_WITHOUT_ID", "DUPLICATE_IN_SCRIPT", "OUT_OF_ORDER", "ANSWER_COUNT_MISMATCH", "HUMAN_VS_REPROCESS_CONFLICT",
)
DISCARD_REASONS = ("INSIDE_ANSWER_AREA", "NOT_A_MARKER_PATTERN", "IMPLAUSIBLE_SHAPE", "HEADER_TOKEN", "VALUER_INK")
RESOLUTION_METHODS = ("EXACT_UNIQUE", "CONSTRAINED_UNIQUE", "NONE")
START_METHODS = ("LANDMARK_LINE", "FALLBACK_OFFSET", "MANUAL")
RESULT_SOURCES = ("AUTOMATIC", "REVIEWER_CORRECTED", "REVIEWER_ADDED")
PAGE_ROLES = ("ANSWER", "COVER", "DO_NOT_WRITE", "INSTRUCTIONS")
PROCESSING_STATUS = ("PROCESSED", "SKIPPED_BY_ROLE", "FAILED_RETRYABLE", "FAILED_PERMANENT")
CONTENT_CLASSES = ("BLANK", "SPARSE", "NORMAL", "TEMPLATE")
PARSE_FLAGS = ("PREFIX_RESIDUE", "NOISE_STRIPPED", "LINE_TRIMMED")
SCRIPT_FLAGS = ("DUPLICATE_QUESTION", "OUT_OF_ORDER", "ANSWER_COUNT_MISMATCH", "NO_MARKERS", "POSSIBLE_MISSED_MARKER", "INCOMPLETE")
REVIEW_ACTIONS = ("CONFIRM", "CORRECT", "REJECT", "ADD")
PARSE_KINDS = ("MARKER", "PREFIX_ONLY", "NOT_A_MARKER")
OUTCOMES = ("RESOLVED", "AMBIGUOUS", "NO_MATCH")

BOX = "struct<x:int,y:int,width:int,height:int>"
LAYOUT = (
    "struct<found:boolean,margin_rule_x:int,header_y:int,ruled_line_ys:array<int>,line_pitch_px:double,parity:string,"
    "skew_deg:double,deskewed:boolean>"
)
OBSERVATIONS = (
    f"script_id string, page_index int, candidate_pos int, raw string, recognition_confidence double, box {BOX},"
    " detection_confidence double, polygon array<array<double>>"
)
PAGES = (
    "script_id string, page_index int, page_role string, processing_status string, content_class string, dpi double,"
    f" is_colour boolean, layout {LAYOUT}"
)
VOCABULARY_ENTRIES = "exam_id string, version string, ord int, raw string, explicit_target boolean"
EXAM_RULES = "exam_id string, min_answers int, max_answers int"
CONFUSIONS = "ocr_char string, expected_char string, cost double"
CALIBRATION = "raw double, calibrated double"
PAGE_ROLE_ROWS = "page_index int, role string"
REVIEWS = (
    "marker_result_id string, action string, original map<string,string>, corrected map<string,string>, reviewer string,"
    " reviewed_at timestamp, reason string"
)
