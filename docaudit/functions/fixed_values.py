"""Values fixed by the document formats and the data model.

FIXED VALUES: every constant below must keep exactly this content, because results
depend on it. They are stated as plain text in their natural order; the logic that
uses them lives elsewhere.
"""

# --- characters removed by a text strip (Unicode white space plus the ASCII separators) ---
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\s\x1c-\x1f]"  # use with (?U)
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"

# --- words that mean "not stated" ---
BLANK_WORDS = ["", "n/a", "na", "none", "null", "-", "없음", "미기재"]
NUMBER_TOKEN = r"-?[0-9.,]+"

# --- amounts, limits ---
AMOUNT_TOLERANCE = 0.02
STALE_MINUTES = 90
EXCERPT_LIMIT = 24000
EXCERPT_MARK = "\n\n...[중략]...\n\n"
PREVIEW_LIMIT = 12000
UPLOAD_EXTENSIONS = [
    "pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "html", "htm", "md", "txt",
    "csv", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp",
]

# --- states and labels ---
PROCESSING, PENDING, ERROR, VALIDATED, FAILED = (
    "PROCESSING", "PENDING", "ERROR", "VALIDATED", "FAILED",
)
STATUS_LABELS = {
    "PROCESSING": "⏳ 처리 중",
    "PENDING": "🟡 검증 통과",
    "ERROR": "🔴 오류",
    "VALIDATED": "🟢 승인 완료",
    "FAILED": "⚫ 처리 실패",
    "SKIPPED": "⏭️ 중복 건너뜀",
}
DOC_TYPE_LABELS = {"INVOICE": "송장", "RECEIPT": "영수증", "UNKNOWN": "문서"}
DOC_NUMBER_LABELS = {"INVOICE": "invoice number", "RECEIPT": "receipt number", "UNKNOWN": "document number"}
UNKNOWN_VENDOR = "(미확인)"

# --- header columns ---
HEADER_TEXT = [
    "doc_type", "invoice_number", "issue_date", "due_date",
    "vendor_name", "buyer_name", "po_number", "currency",
]
HEADER_AMOUNTS = ["subtotal", "tax", "shipping", "total_amount"]
GROUNDED_FIELDS = [
    ("invoice_number", "text"),
    ("po_number", "text"),
    ("vendor_name", "text"),
    ("buyer_name", "text"),
    ("issue_date", "date"),
    ("due_date", "date"),
    ("subtotal", "number"),
    ("tax", "number"),
    ("shipping", "number"),
    ("total_amount", "number"),
]
REQUIRED_FIELDS = ["invoice_number", "issue_date", "vendor_name"]
EDITABLE_FIELDS = [
    "doc_type", "invoice_number", "issue_date", "due_date", "vendor_name",
    "buyer_name", "po_number", "line_items", "currency", "subtotal", "tax",
    "shipping", "total_amount",
]

# --- dates ---
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ["d.M.yyyy"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["d/M/yyyy", "M/d/yyyy"]),
]
DATE_SEPARATORS = [".", "/", "-", " "]
# y year, m/mm month, d/dd day, name the month's name
DATE_ORDERS = ["dd{s}mm{s}y", "mm{s}dd{s}y", "y{s}mm{s}dd", "d{s}m{s}y", "m{s}d{s}y"]
MONTH_NAME_FORMS = [
    "name dd, y", "name d, y", "name dd y", "name d y",
    "dd name y", "d name y", "d-name-y", "dd-name-y",
]
KOREAN_DATE_FORMS = ["y년 m월 d일", "y년 mm월 d일"]

# --- table rows ---
SUMMARY_WORDS = (
    r"\b(?:sub\s*total|sales\s*tax|vat|shipping|handling|total\s*due|amount\s*due|"
    r"balance\s*due|grand\s*total)\b|합계|소계|부가세|공급가액"
)
SUMMARY_LABELS = [
    "total", "subtotal", "sub total", "sub-total", "tax", "vat", "sales tax",
    "shipping", "handling", "discount", "balance", "amount due", "total due",
    "grand total", "합계", "소계", "총계", "부가세", "세액", "공급가액", "할인",
]
EMBEDDED_QUANTITY = [
    r"\((\d+(?:\.\d+)?)\)\s*$",
    r"\bqty\.?\s*[:x]?\s*(\d+(?:\.\d+)?)",
    r"\bx\s*(\d+(?:\.\d+)?)\s*$",
    r"\((\d+(?:\.\d+)?)\)",
]
COLUMN_HINTS = [
    ("unit_price", ["unit price", "item price", "unit cost", "rate", "price", "단가"]),
    ("tax", ["tax", "vat", "세액", "부가세"]),
    ("amount", ["line total", "total", "amount", "금액", "합계"]),
    ("description", ["description", "service", "product", "item", "품목", "내역", "적요"]),
    ("quantity", ["quantity", "qty", "ordered", "units", "수량"]),
]
ROW_NUMBER_NAMES = [
    "#", "no", "no.", "num", "item", "item #", "item#", "item no", "item no.",
    "번호", "순번", "품번",
]
CURRENCY = r"[€$£¥₩]|(?:usd|eur|gbp|krw|jpy|cad|aud|chf|cny)\b|원"
UNIT = r"(?:pcs?|pieces?|ea|units?|hrs?|hours?|days?|개)\b\.?"
TRAILING_NUMBER = r"(\d[\d,]*\.?\d*)\s*$"
ITEM_NUMBER_CELL = r"^\s*(\d{1,4})\.?\s*$"
LEADING_ITEM_NUMBER = r"^(\d{1,4})\s+(?=\S)"
QUANTITY_TEXT = (
    r"(?<![\w.])\d+(?:[.,]\d+)?\s*"
    r"(?:pcs\b\.?|pc\b\.?|pieces?\b|units?\b|ea\b\.?|개)"
)
NUMBERED_LINE = r"^[ \t]*\|?[ \t]*([1-9]\d*)\.(?=[ \t|]|$)"

# --- layout ---
ANCHOR = r"^\s*(\d{1,3})\.(?=\s|$)"
ANCHOR_SLACK = 0.5
DEFAULT_ROW_GAP = 40.0

# --- document types and titles ---
DECLARATIONS = {
    "RECEIPT": ["receipt#", "receipt #", "receipt no", "영수증", "수령증"],
    "INVOICE": ["invoice#", "invoice #", "invoice no", "세금계산서", "청구서"],
}
TYPE_WORDS = {"RECEIPT": ["receipt"], "INVOICE": ["invoice"]}
HEADING = r"^#{1,3}\s+(.+?)\s*$"
TITLE_DOC_WORDS = r"invoice|receipt|bill\s*to|ship\s*to|영수증|청구서|세금계산서"
STRUCTURE_TITLES = [
    "to", "from", "bill to", "ship to", "sold to", "remit to", "comments", "notes",
    "description", "terms", "summary", "details", "items", "수신", "발신", "비고",
    "적요", "내역", "합계",
]
MARKUP_RUN = r"[|#*`_]+"
WORD = r"[0-9a-z가-힣]+"
APPENDIX_HEADING = "\n\n## (레이아웃 밖에서 읽은 텍스트)\n\n"
