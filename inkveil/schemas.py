"""Row types, and the fixed values (enumerations, limits, patterns) that results depend on."""

from __future__ import annotations

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
MANIFEST = (
    f"schema_version int, job_id string, page_count int, detections array<struct<id:string,page_index:int,category:string,"
    f"box:{BOX},confidence:double,source:string,fingerprint:string>>, detector_version string, prompt_version string, "
    "model_id string, created_at timestamp, rotation int"
)

# Fixed values.
ACTIVE = ("awaiting_upload", "queued_detection", "detecting", "review_required", "queued_redaction", "redacting")
QUEUED = ("queued_detection", "queued_redaction")
IN_FLIGHT = ("detecting", "redacting")
TERMINAL = ("deleted", "expired")
CATEGORY_OF_ANSWER = {
    "client_name": "person_name", "client_tin": "ssn", "address_line": "street_address", "private_id": "other_private_id",
    "email": "email", "phone": "phone", "dob": "date_of_birth",
}
PROPAGATED = ("person_name", "ssn", "street_address")
TAXPAYER_IDS = ("ssn", "itin")
TEXTLESS_ANNOTATIONS = ("Link", "Popup", "Highlight", "Underline", "StrikeOut", "Squiggly")
CATEGORY_NOUNS = {
    "email": ("email", "emails"), "phone": ("phone number", "phone numbers"), "ip_address": ("IP address", "IP addresses"),
    "payment_card": ("payment card", "payment cards"), "ssn": ("SSN", "SSNs"), "person_name": ("person name", "person names"),
    "street_address": ("street-address line", "street-address lines"), "user_added": ("added by you", "added by you"),
}
EXTENSIONS = {
    ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tif": "image/tiff", ".tiff": "image/tiff",
}
#: The leading bytes that a file of an extension must have, one of them.
SIGNATURES = {
    ".pdf": (b"%PDF-",), ".png": (b"\x89PNG\r\n\x1a\n",), ".jpg": (b"\xff\xd8\xff",), ".jpeg": (b"\xff\xd8\xff",),
    ".tif": (b"II*\x00", b"MM\x00*"), ".tiff": (b"II*\x00", b"MM\x00*"),
}
#: What a written PDF must not hold.
FORBIDDEN_MARKERS = ("/EmbeddedFile", "/JavaScript", "/JS ", "/AcroForm")
PRIVATE_COLUMNS = ("access_token", "document_text", "filename")
RESPONSE_FIELDS = ("job_id", "status", "expires_at", "page_count", "pages_completed", "finding_count", "error_code")
FINDING_FIELDS = ("page_index", "category", "box", "confidence", "source")
COUNTERS = (
    "Visits", "LandingViews", "AppViews", "SelfHostingViews", "DocumentsSubmitted", "DocumentsCompleted", "PagesCompleted",
    "DocumentsFailed", "DocumentsDownloaded", "DownloadsStarted", "BatchesSelected", "BatchDocumentsSelected",
)
PERMANENT_ERRORS = (
    "upload_too_large", "unsupported_file_type", "file_signature_mismatch", "too_many_pages", "pdf_password_protected",
    "pdf_unreadable", "pdf_render_failed", "image_unreadable", "document_empty", "page_dimensions_too_large",
    "document_dimensions_too_large", "ocr_unavailable", "model_output_invalid", "model_output_truncated",
    "detection_unanchored", "residual_identifier_detected", "degenerate_redaction_box",
)
CAPACITY_ERRORS = ("hourly_abuse_limit", "active_job_abuse_limit", "service_busy")
MAX_PAGE_PIXELS, MAX_DOCUMENT_PIXELS = 24_000_000, 1_300_000_000
SSN_SHAPE = "^[\\dxX*•]{3}[-–][\\dxX*•]{2}[-–][\\dxX*•]{4}$"
#: (from, to) of the job's state machine, by trigger.
TRANSITIONS = (
    ("submit", "awaiting_upload", "queued_detection"), ("reject_upload", "awaiting_upload", "failed"),
    ("unqueue", "queued_detection", "awaiting_upload"), ("claim", "queued_detection", "detecting"),
    ("claim", "queued_redaction", "redacting"), ("requeue", "detecting", "queued_detection"),
    ("requeue", "redacting", "queued_redaction"), ("auto", "detecting", "redacting"),
    ("detected", "detecting", "review_required"), ("finalize", "review_required", "queued_redaction"),
    ("finalize", "complete", "queued_redaction"), ("complete", "redacting", "complete"),
    ("recheck", "redacting", "review_required"), ("fail", "detecting", "failed"), ("fail", "redacting", "failed"),
)
