"""Word lists, character sets and limits that decide results.

Patterns are written for Java's regex engine with explicit Unicode classes, so
that they mean the same for every language of text.
"""

# --- fixed values: file kinds -------------------------------------------------
PDF_EXTENSIONS = (".pdf",)
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tiff", ".bmp")
TEXT_EXTENSIONS = (".txt",)
SUPPORTED_EXTENSIONS = PDF_EXTENSIONS + IMAGE_EXTENSIONS + TEXT_EXTENSIONS

# --- fixed values: field keywords, in the order they are tried ----------------
SELLER_KEYWORDS = ("from", "seller", "vendor", "supplier", "issued by", "bill from")
BUYER_KEYWORDS = ("to", "bill to", "customer", "client", "recipient", "ship to")
ADDRESS_KEYWORDS = ("address", "street", "city", "state", "zip", "postal", "country")
INVOICE_NUMBER_KEYWORDS = (
    "invoice no", "invoice number", "invoice#", "inv no", "bill no", "bill number", "invoice id",
)
SALESPERSON_KEYWORDS = ("salesperson", "sales rep", "account manager", "representative")
STREET_WORDS = (
    "street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "boulevard", "blvd",
)
INVOICE_NUMBER_PREFIXES = (
    "invoice", "inv", "bill", "bill no", "invoice no", "invoice#", "inv.",
)

# --- fixed values: table and summary words (substring tests) ------------------
HEADER_WORDS = (
    "description", "item", "quantity", "qty", "rate", "price", "amount", "total",
    "unit price", "subtotal",
)
FOOTER_STARTS = ("total", "subtotal", "grand total", "balance due")
SUMMARY_ROW_WORDS = ("subtotal", "total", "vat", "gross", "balance", "due")
SUMMARY_DESCRIPTION_WORDS = (
    "subtotal", "total due", "total", "sales tax", "vat", "tax", "grand total",
    "balance due", "amount due", "gst",
)
TAX_WORDS = ("tax", "vat", "gst")
TOTAL_WORDS = ("total", "amount due", "grand total", "balance due")

# --- fixed values: limits ------------------------------------------------------
INVOICE_NUMBER_LENGTH = 120
PREVIEW_LENGTH = 500
LINE_CENTRE_TOLERANCE = 8
CELL_ROW_TOLERANCE = 10
MIN_CELL_AREA = 1000
MISMATCH_TOLERANCE = 0.5
DEFAULT_CONFIDENCE = 100.0
NO_CONFIDENCE = -1
CELL_SEPARATOR = " | "
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# --- character classes ---------------------------------------------------------
# The characters Unicode-aware text tools strip and split on.
SPACE_CHARS = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
# The same as a class. Few members, as every one is a test per character.
SPACE_SET = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\p{Z}"
SPACE = f"[{SPACE_SET}]"
NOT_SPACE = f"[^{SPACE_SET}]"
WORD_SET = r"_\p{L}\p{N}"
WORD = f"[{WORD_SET}]"
DIGIT = r"\p{Nd}"
# The characters that end a line, and the white space within one.
LINE_END_SET = r"\n\x0B\f\r\x1C\x1D\x1E\x85\x{2028}\x{2029}"
LINE_END = rf"\r\n|[{LINE_END_SET}]"
INLINE_SPACE_SET = r"\t\x1F \p{Zs}"
