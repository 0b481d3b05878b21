"""Rule catalogues shared by the operators.

Everything here is a fixed value: word lists, label lists, patterns and
thresholds that decide results, stated as plain data in their defining order
(order breaks ties).  Patterns use the common notation understood by
``regex.java``: ``\\w``, ``\\s``, ``\\d`` and ``\\b`` are Unicode-aware there.
"""

from __future__ import annotations

# --- fixed values: document types -------------------------------------------------
# type -> (weight, keywords, patterns); patterns run on lower-cased text

DOCUMENT_RULES = {
    "invoice": (
        1.0,
        ["invoice", "bill to", "ship to", "invoice number", "invoice date", "due date", "payment terms",
         "subtotal", "tax", "total due", "remit to", "purchase order", "qty", "unit price", "amount due"],
        [r"invoice\s*#?\s*:?\s*\w+", r"inv\s*-?\s*\d+", r"bill\s+to\s*:", r"payment\s+due",
         r"total\s+amount\s*:?\s*\$?"],
    ),
    "receipt": (
        1.0,
        ["receipt", "transaction", "paid", "cash", "credit card", "change", "subtotal", "tax", "total",
         "thank you", "store", "cashier", "items"],
        [r"receipt\s*#?\s*:?\s*\w+", r"transaction\s*id", r"paid\s+by", r"change\s*:?\s*\$?\d+"],
    ),
    "contract": (
        1.0,
        ["agreement", "contract", "terms and conditions", "party", "whereas", "hereby", "witnesseth",
         "covenant", "binding", "executed", "signature", "effective date", "termination"],
        [r"this\s+agreement", r"parties\s+agree", r"terms\s+and\s+conditions", r"binding\s+agreement"],
    ),
    "form": (
        1.0,
        ["form", "application", "please fill", "required fields", "checkbox", "select",
         "signature required", "date of birth", "applicant", "submit"],
        [r"form\s*#?\s*:?\s*\w+", r"please\s+(fill|complete)", r"\[\s*\]", r"_+\s*\(.*?\)"],
    ),
    "letter": (
        0.9,
        ["dear", "sincerely", "regards", "yours truly", "to whom", "attention", "re:", "subject:",
         "enclosed"],
        [r"dear\s+\w+", r"sincerely\s*,", r"regards\s*,", r"to\s+whom\s+it\s+may\s+concern"],
    ),
    "report": (
        0.9,
        ["report", "summary", "analysis", "findings", "conclusion", "executive summary", "methodology",
         "results", "recommendations"],
        [r"executive\s+summary", r"table\s+of\s+contents", r"section\s+\d+", r"figure\s+\d+"],
    ),
    "id_document": (
        1.0,
        ["passport", "driver license", "identification", "id card", "date of birth", "expiry",
         "nationality", "sex", "height"],
        [r"passport\s*no", r"license\s*#", r"date\s+of\s+birth", r"expir(y|ation)\s+date"],
    ),
    "bank_statement": (
        1.0,
        ["statement", "account", "balance", "deposit", "withdrawal", "transaction", "opening balance",
         "closing balance", "interest"],
        [r"account\s*(number|#)", r"statement\s+period", r"opening\s+balance", r"closing\s+balance"],
    ),
    "tax_document": (
        1.0,
        ["tax", "w-2", "1099", "irs", "income", "deduction", "federal", "state", "employer", "wages",
         "withholding"],
        [r"form\s+w-?2", r"form\s+1099", r"tax\s+year", r"taxable\s+income"],
    ),
    "medical": (
        1.0,
        ["patient", "diagnosis", "prescription", "medication", "doctor", "physician", "hospital",
         "clinic", "medical", "treatment", "dosage", "symptoms"],
        [r"patient\s+(name|id)", r"date\s+of\s+service", r"diagnosis\s*:", r"rx\s*:"],
    ),
}
UNKNOWN = "unknown"
MIN_TYPE_SCORE = 0.1
TYPE_ROUTES = {
    "invoice": "invoice", "receipt": "receipt", "contract": "contract",
    "bank_statement": "bank_statement", "tax_document": "tax_document", "medical": "medical",
}
DEFAULT_ROUTE = "general"

# --- fixed values: languages -------------------------------------------------------
# language -> (script, common words, characteristic patterns)

LANGUAGE_RULES = {
    "en": ("latin", ["the", "and", "is", "in", "to", "of", "a", "for", "that", "with"],
           [r"\bthe\b", r"\band\b", r"\bis\b"]),
    "es": ("latin", ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las"],
           [r"\bque\b", r"\bdel\b", "ñ", "¿", "¡"]),
    "fr": ("latin", ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
           [r"\bqu['e]", r"\bc'est\b", "œ", "ç"]),
    "de": ("latin", ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
           [r"\bder\b", r"\bdie\b", r"\bund\b", "ß", "ü", "ö", "ä"]),
    "it": ("latin", ["di", "che", "la", "il", "un", "per", "con", "non", "una", "sono"],
           [r"\bche\b", r"\bnon\b", r"\bper\b"]),
    "pt": ("latin", ["de", "que", "e", "do", "da", "em", "um", "para", "com", "não"],
           [r"\bnão\b", r"\bpara\b", "ã", "õ"]),
    "nl": ("latin", ["de", "het", "een", "van", "en", "in", "is", "dat", "op", "te"],
           [r"\bhet\b", r"\been\b", r"\bvan\b", "ij"]),
    "ru": ("cyrillic", ["и", "в", "не", "на", "я", "что", "он", "с", "это", "как"], ["[а-яА-Я]"]),
    "zh": ("cjk", ["的", "一", "是", "不", "了", "在", "人", "有", "我", "他"], ["[\u4e00-\u9fff]"]),
    "ja": ("japanese", ["の", "に", "は", "を", "た", "が", "で", "て", "と", "し"],
           ["[\u3040-\u309f]", "[\u30a0-\u30ff]"]),
    "ko": ("hangul", ["이", "그", "저", "것", "수", "하다", "있다", "되다", "없다"], ["[\uac00-\ud7af]"]),
    "ar": ("arabic", ["من", "في", "على", "إلى", "عن", "مع", "هذا", "أن", "كان", "لا"], ["[\u0600-\u06ff]"]),
    "hi": ("devanagari", ["का", "की", "को", "में", "है", "और", "से", "के", "एक", "यह"], ["[\u0900-\u097f]"]),
    "th": ("thai", ["ที่", "และ", "ใน", "ของ", "มี", "เป็น", "ได้", "จะ", "นี้", "ไม่"], ["[\u0e00-\u0e7f]"]),
}
# script -> code point range, in tie-breaking order
SCRIPT_RANGES = {
    "latin": (0x0000, 0x024F),
    "cyrillic": (0x0400, 0x04FF),
    "arabic": (0x0600, 0x06FF),
    "cjk": (0x4E00, 0x9FFF),
    "hangul": (0xAC00, 0xD7AF),
    "devanagari": (0x0900, 0x097F),
    "thai": (0x0E00, 0x0E7F),
    "japanese": (0x3040, 0x30FF),
    "hebrew": (0x0590, 0x05FF),
    "greek": (0x0370, 0x03FF),
}
SUPPORTED_LANGUAGES = [
    "en", "es", "fr", "de", "it", "pt", "nl", "ru", "zh", "ja", "ko", "ar", "hi", "th", "vi", "id", "ms",
    "tr", "pl", "sv", "no", "da", "fi", "el", "he", "cs", "ro", "hu", "uk",
]
SECONDARY_SCORE = 0.1
LOCAL_LABELS = {
    "invoice_number": {"en": "invoice number", "es": "número de factura", "fr": "numéro de facture",
                       "de": "rechnungsnummer", "it": "numero fattura", "pt": "número da fatura"},
    "date": {"en": "date", "es": "fecha", "fr": "date", "de": "datum", "it": "data", "pt": "data"},
    "total": {"en": "total", "es": "total", "fr": "total", "de": "gesamt", "it": "totale", "pt": "total"},
    "tax": {"en": "tax", "es": "impuesto", "fr": "taxe", "de": "steuer", "it": "tassa", "pt": "imposto"},
}

# --- fixed values: entities ---------------------------------------------------------
# type -> patterns, case-sensitive

ENTITY_PATTERNS = {
    "person": [r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", r"(?:Mr\.|Mrs\.|Ms\.|Dr\.)\s+[A-Z][a-z]+"],
    "organization": [r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc\.|Corp\.|LLC|Ltd\.)",
                     r"[A-Z]{2,}\s+(?:Corporation|Company|Industries)"],
    "date": [r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
             r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
             r"\s+\d{1,2},?\s+\d{4}",
             r"\d{4}-\d{2}-\d{2}"],
    "money": [r"\$[\d,]+\.?\d*", r"[\d,]+\.?\d*\s*(?:USD|EUR|GBP)", r"(?:€|£|¥)[\d,]+\.?\d*"],
    "email": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
    "phone": [r"\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\(\d{3}\)\s*\d{3}-\d{4}"],
    "address": [r"\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd)"],
}
ENTITY_CONFIDENCE = 0.8
ENTITY_LIMIT = 20
PERSON_LABELS = [
    "bill to", "ship to", "sold to", "deliver to", "ship mode", "second class", "first class",
    "standard class", "balance due", "amount due", "total due", "grand total", "sub total", "thank you",
    "terms and", "notes and", "order id", "invoice number", "receipt number", "customer id",
]
PERSON_STOP_PARTS = ["inkjet", "laser", "printer", "machine", "class"]
SUMMARY_PARTS = [("organization", "organization(s)"), ("person", "person(s)"),
                 ("money", "monetary value(s)"), ("date", "date(s)")]

# context -> (trigger substrings, field -> pattern), case-insensitive
CONTEXT_RULES = {
    "payment_info": (
        ["payment", "pay", "due", "amount", "total"],
        {"amount": r"(?:total|amount|due|payment)\s*:?\s*\$?([\d,]+\.?\d*)",
         "due_date": r"(?:due|payment)\s+(?:date|by)\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
         "method": r"(?:pay|payment)\s+(?:by|via|method)\s*:?\s*(\w+)"},
    ),
    "contact_info": (
        ["contact", "phone", "email", "address", "reach"],
        {"phone": r"(?:phone|tel|call)\s*:?\s*([\d\s\-\(\)]+)",
         "email": r"(?:email|e-mail)\s*:?\s*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
         "address": r"(?:address|location)\s*:?\s*(.+?)(?:\n|$)"},
    ),
    "identification": (
        ["id", "number", "reference", "account"],
        {"id_number": r"(?:id|identification|account|reference)\s*(?:number|#|no)?\s*:?\s*([A-Z0-9\-]+)",
         "customer_id": r"(?:customer|client)\s*(?:id|#)\s*:?\s*([A-Z0-9\-]+)"},
    ),
    "dates": (
        ["date", "issued", "effective", "expires"],
        {"issue_date": r"(?:issue|issued|created)\s+(?:date)?\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
         "effective_date": r"(?:effective|start)\s+(?:date)?\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
         "expiry_date": r"(?:expir|end)\w*\s+(?:date)?\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"},
    ),
}
CONTEXT_CONFIDENCE = 0.85

# question word -> pattern, case-insensitive, tried in this order
QUESTION_PATTERNS = {
    "total": r"total\s*:?\s*\$?([\d,]+\.?\d*)",
    "date": r"date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    "name": r"(?:name|from|to)\s*:?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
    "number": r"(?:number|#|no)\s*:?\s*([A-Z0-9\-]+)",
    "amount": r"(?:amount|sum|price)\s*:?\s*\$?([\d,]+\.?\d*)",
    "address": r"address\s*:?\s*(.+?)(?:\n|$)",
    "email": r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
    "phone": r"(\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})",
}
QUESTION_CONFIDENCE = 0.75

BULLET_PATTERN = r"(?:^|\n)\s*(?:[\•\-\*]|\d+\.)\s*(.+?)(?:\n|$)"
IMPORTANT_PATTERNS = [r"(?:important|note|attention|warning)\s*:?\s*(.+?)(?:\n|$)",
                      r"(?:please|must|required)\s+(.+?)(?:\n|$)"]

# --- fixed values: labelled fields ---------------------------------------------------

LABEL_FIELDS = [
    "Company Name", "Company Address", "Company Phone", "Company Email", "Company Website",
    "Invoice Number", "Invoice Date", "Due Date", "PO Number", "Reference Number",
    "Bill To Name", "Bill To Address", "Bill To Phone", "Bill To Email",
    "Ship To Name", "Ship To Address", "Ship To Phone", "Ship To Email",
    "Subtotal", "Tax Amount", "Tax Rate", "Discount Amount", "Shipping Cost",
    "Total Amount", "Amount Paid", "Amount Due", "Currency",
    "Payment Terms", "Payment Method", "Bank Name", "Account Number", "SWIFT Code",
    "Item Description", "Item Quantity", "Item Unit Price", "Item Total",
    "Customer ID", "Vendor ID", "Department", "Project Code",
    "Notes", "Terms and Conditions", "Signature", "Date of Signature",
    "Sales Person", "Customer Service Rep", "Approval Status", "Document Type",
    "Purchase Order Number", "Contract Number", "License Number", "Registration Number",
]

# --- fixed values: structured fields per document type; case-insensitive, multi-line ---

COMMON_FIELDS = {
    "date": [r"(?:Date|Dated?)\s*:?\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
             r"(?:Date|Dated?)\s*:?\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"],
    "total": [r"(?:Total|Grand Total|Amount Due|Balance Due)\s*:?\s*\*?\*?\s*\$?([\d,]+\.?\d*)"],
}
TYPE_FIELDS = {
    "invoice": {
        "invoice_number": [r"(?:Invoice|INV)\s*#?\s*:?\s*(\w+)", r"#\s*(\d+)"],
        "bill_to": [r"Bill\s+To\s*:?\s*\*?\*?([^*\n]+?)(?:\n\n|\nShip)",
                    r"Bill\s+To\s*:?\s*\*?\*?\s*([A-Za-z][A-Za-z\s]+?)(?:\n|Ship)"],
        "ship_to": [r"Ship\s+To\s*:?\s*\*?\*?\s*([^\n]+)"],
        "subtotal": [r"Subtotal\s*:?\s*\$?([\d,]+\.?\d*)"],
        "discount": [r"Discount\s*(?:\([^)]+\))?\s*:?\s*\$?([\d,]+\.?\d*)"],
        "tax": [r"Tax\s*(?:\([^)]+\))?\s*:?\s*\$?([\d,]+\.?\d*)"],
        "shipping": [r"Shipping\s*:?\s*\$?([\d,]+\.?\d*)"],
        "ship_mode": [r"Ship\s+Mode\s*:?\s*([^\n]+)"],
        "order_id": [r"Order\s+ID\s*:?\s*([^\n]+)"],
        "notes": [r"Notes\s*:?\s*([^\n]+)"],
        "terms": [r"Terms\s*:?\s*([^\n]+)"],
    },
    "receipt": {
        "receipt_number": [r"(?:Receipt|Transaction)\s*#?\s*:?\s*(\w+)"],
        "store": [r"^([A-Za-z\s]+?)(?:\n|Receipt)"],
        "cashier": [r"Cashier\s*:?\s*([^\n]+)"],
        "payment_method": [r"(?:Paid|Payment)\s+(?:by|via)\s*:?\s*([^\n]+)"],
    },
    "contract": {
        "contract_date": [r"(?:dated?|entered into)\s+(?:as of\s+)?([A-Za-z]+\s+\d{1,2},?\s+\d{4})"],
        "parties": [r"(?:between|parties?)\s*:?\s*([^\n]+)"],
        "effective_date": [r"effective\s+(?:date)?\s*:?\s*([^\n]+)"],
    },
    "bank_statement": {
        "account_number": [r"(?:Account|Acct)\s*#?\s*:?\s*([X\d\-]+)", r"Account\s+Number\s*:?\s*([^\n]+)"],
        "statement_period": [r"(?:Statement\s+Period|Period)\s*:?\s*([^\n]+)"],
        "opening_balance": [r"(?:Opening|Beginning)\s+Balance\s*:?\s*\$?([\d,]+\.?\d*)"],
        "closing_balance": [r"(?:Closing|Ending)\s+Balance\s*:?\s*\$?([\d,]+\.?\d*)"],
        "total_deposits": [r"(?:Total\s+)?Deposits\s*:?\s*\$?([\d,]+\.?\d*)"],
        "total_withdrawals": [r"(?:Total\s+)?Withdrawals\s*:?\s*\$?([\d,]+\.?\d*)"],
    },
    "id_document": {
        "document_number": [r"(?:ID|License|Passport)\s*#?\s*:?\s*([A-Z0-9\-]+)",
                            r"(?:Number|No\.?)\s*:?\s*([A-Z0-9\-]+)"],
        "full_name": [r"(?:Name|Full\s+Name)\s*:?\s*([A-Za-z\s]+)"],
        "date_of_birth": [r"(?:DOB|Date\s+of\s+Birth|Birth\s+Date)\s*:?\s*([^\n]+)"],
        "expiration_date": [r"(?:Exp|Expires?|Expiration)\s*:?\s*([^\n]+)"],
        "issue_date": [r"(?:Issued?|Issue\s+Date)\s*:?\s*([^\n]+)"],
        "address": [r"(?:Address|Addr)\s*:?\s*([^\n]+)"],
    },
    "medical": {
        "patient_name": [r"(?:Patient|Name)\s*:?\s*([A-Za-z\s]+)"],
        "patient_id": [r"(?:Patient|Medical)\s*(?:ID|#)\s*:?\s*([^\n]+)", r"MRN\s*:?\s*([^\n]+)"],
        "provider": [r"(?:Provider|Physician|Doctor)\s*:?\s*([^\n]+)"],
        "diagnosis": [r"(?:Diagnosis|Dx)\s*:?\s*([^\n]+)"],
        "visit_date": [r"(?:Visit|Service)\s+Date\s*:?\s*([^\n]+)"],
        "facility": [r"(?:Facility|Hospital|Clinic)\s*:?\s*([^\n]+)"],
    },
    "tax_document": {
        "tax_year": [r"(?:Tax\s+Year|Year)\s*:?\s*(\d{4})"],
        "form_type": [r"Form\s+(\d+[A-Z\-]*)"],
        "taxpayer_name": [r"(?:Taxpayer|Name)\s*:?\s*([^\n]+)"],
        "ssn": [r"(?:SSN|Social\s+Security)\s*:?\s*([X\d\-]+)"],
        "gross_income": [r"(?:Gross\s+Income|Total\s+Income)\s*:?\s*\$?([\d,]+\.?\d*)"],
        "tax_due": [r"(?:Tax\s+Due|Amount\s+Owed)\s*:?\s*\$?([\d,]+\.?\d*)"],
        "refund": [r"(?:Refund|Amount\s+Refunded)\s*:?\s*\$?([\d,]+\.?\d*)"],
    },
}
# flat field -> key of the one-entry object it becomes
NESTED_FIELDS = {"bill_to": "name", "ship_to": "location"}
# line-item column -> accepted header spellings
LINE_ITEM_HEADERS = {
    "description": ["item", "description", "product"],
    "quantity": ["quantity", "qty"],
    "rate": ["rate", "price", "unit price"],
    "amount": ["amount", "total", "subtotal"],
}
SKU_PATTERN = r"([A-Z]+-[A-Z]+-\d+)"

# --- fixed values: schema-driven extraction --------------------------------------------

SCHEMA_TYPES = {
    "string": r".+",
    "number": r"-?\d+\.?\d*",
    "integer": r"-?\d+",
    "boolean": r"(?:true|false|yes|no|1|0)",
    "date": r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"[\d\s\-\+\(\)]{7,20}",
    "currency": r"[\$€£¥]?\s*[\d,]+\.?\d*",
}
OTHER_SCHEMA_TYPE = r".+?"
CUSTOM_WEIGHT, SAME_LINE_WEIGHT, NEXT_LINE_WEIGHT, BARE_WEIGHT = 0.95, 0.9, 0.85, 0.5

INVOICE_SCHEMA = {
    "type": "object",
    "required": ["invoice_number", "total_amount"],
    "properties": {
        "invoice_number": {"type": "string", "description": "Invoice number or ID",
                           "pattern": r"(?:invoice|inv|#)\s*[:\-]?\s*([A-Z0-9\-]+)"},
        "invoice_date": {"type": "string", "description": "Invoice date",
                         "pattern": r"(?:date|dated)\s*[:\-]?\s*(\d{1,4}[-/]\d{1,2}[-/]\d{1,4})"},
        "due_date": {"type": "string", "description": "Payment due date"},
        "vendor_name": {"type": "string", "description": "Vendor or supplier name"},
        "total_amount": {"type": "number", "description": "Total invoice amount", "minimum": 0,
                         "pattern": r"(?:total|amount|sum|due)\s*[:\-]?\s*[\$€£]?\s*([\d,]+\.?\d*)"},
        "tax_amount": {"type": "number", "description": "Tax amount", "minimum": 0,
                       "pattern": r"(?:tax|vat|gst)\s*[:\-]?\s*[\$€£]?\s*([\d,]+\.?\d*)"},
        "currency": {"type": "string", "enum": ["USD", "EUR", "GBP", "JPY", "CAD", "AUD"]},
    },
}
RECEIPT_SCHEMA = {
    "type": "object",
    "required": ["total_amount"],
    "properties": {
        "store_name": {"type": "string", "description": "Store or merchant name"},
        "date": {"type": "string", "description": "Transaction date"},
        "total_amount": {"type": "number", "description": "Total amount", "minimum": 0},
        "payment_method": {"type": "string", "enum": ["cash", "credit", "debit", "check"]},
        "receipt_number": {"type": "string"},
    },
}

# --- fixed values: files and limits ------------------------------------------------------

IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff"]
DOCUMENT_EXTENSIONS = [".pdf"]
WIDE_EXTENSIONS = [".pdf", ".docx", ".pptx", ".xlsx", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".webp"]
TOKEN_RANGE = (100, 8000)
IMAGE_SIZE_RANGE = (256, 4096)
MIN_KEY_LENGTH = 8
UNSAFE_NAME_PARTS = ["..", "/", "\\", "\x00", "<", ">", "|", "*", "?", '"']
URL_PATTERN = (r"^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|"
               r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$")
BATCH_FILE_LIMIT = 10
MAX_JOB_RETRIES = 3
MAX_DELIVERY_ATTEMPTS = 3

# --- fixed values: messages of checks ---------------------------------------------------------

UNSUPPORTED_FILE = "Unsupported file type: {extension}. Supported: {supported}"
INVALID_URL = "Invalid URL format: {url}"
KEY_MISSING = "API key is required"
KEY_SHORT = "API key must be at least {low} characters"
TOKENS_LOW = "Max tokens must be at least {low}"
TOKENS_HIGH = "Max tokens cannot exceed {high}"
IMAGE_SIZE_LOW = "Image size must be at least {low}"
IMAGE_SIZE_HIGH = "Image size cannot exceed {high}"
TYPE_MISFIT = "Value '{value}' doesn't match type '{kind}'"
NOT_ALLOWED = "Value '{value}' not in allowed values: {allowed}"
BELOW_MINIMUM = "Value below minimum ({low})"
ABOVE_MAXIMUM = "Value above maximum ({high})"
TOO_SHORT = "Value too short (min: {low})"
TOO_LONG = "Value too long (max: {high})"
REQUIRED_MISSING = "Required field '{name}' not found"

# --- fixed values: notification texts ------------------------------------------------------
# event type -> (subject, body); {name} marks a value

MESSAGE_TEMPLATES = {
    "document.processed": (
        "Document Processing Complete",
        "<h2>Document Processed Successfully</h2>\n<p>Your document has been processed.</p>\n<ul>\n"
        "<li><strong>Document ID:</strong> {document_id}</li>\n<li><strong>Pages:</strong> {pages}</li>\n"
        "<li><strong>Processing Time:</strong> {processing_time}</li>\n</ul>\n"
        "<p>You can view the results in your dashboard.</p>"),
    "document.failed": (
        "Document Processing Failed",
        "<h2>Document Processing Failed</h2>\n<p>There was an error processing your document.</p>\n<ul>\n"
        "<li><strong>Document ID:</strong> {document_id}</li>\n<li><strong>Error:</strong> {error}</li>\n</ul>\n"
        "<p>Please try again or contact support.</p>"),
    "export.completed": (
        "Data Export Complete",
        "<h2>Export Completed</h2>\n<p>Your data export has been completed.</p>\n<ul>\n"
        "<li><strong>Export ID:</strong> {export_id}</li>\n<li><strong>Format:</strong> {format}</li>\n"
        "<li><strong>Records:</strong> {records}</li>\n</ul>"),
    "quota.warning": (
        "Usage Quota Warning",
        "<h2>Usage Quota Warning</h2>\n<p>You are approaching your usage limit.</p>\n<ul>\n"
        "<li><strong>Current Usage:</strong> {current}%</li>\n<li><strong>Limit:</strong> {limit}</li>\n</ul>\n"
        "<p>Consider upgrading your plan to avoid service interruption.</p>"),
}
DEFAULT_MESSAGE = ("Notification", "<p>You have a new notification.</p>")
# event type -> (colour, title) of a chat message
CHAT_STYLES = {
    "document.processed": ("#36a64f", ":white_check_mark: Document Processed"),
    "document.failed": ("#ff0000", ":x: Document Processing Failed"),
    "export.completed": ("#2196f3", ":outbox_tray: Export Completed"),
    "quota.warning": ("#ff9800", ":warning: Quota Warning"),
}
DEFAULT_CHAT_STYLE = ("#808080", "Notification")

# --- fixed values: page elements ------------------------------------------------------------
PAGE_MARK = r"\n--- Page (\d+) ---\n"
DISPLAY_EQUATION = r"\$\$([^$]+)\$\$"
INLINE_EQUATION = r"\$([^$]+)\$"
EQUATION_BLOCK = r"\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}"
ALIGN_BLOCK = r"\\begin\{align\*?\}(.*?)\\end\{align\*?\}"
IMAGE = r"<img>(.*?)</img>"
WATERMARK = r"<watermark>(.*?)</watermark>"
PRINTED_NUMBER = r"<page_number>(.*?)</page_number>"
CHECKED, UNCHECKED = "☑", "☐"

# one alternation in document order; only the bodies of environments are groups
ANY_EQUATION = (r"\$\$[^$]+\$\$|\$[^$]+\$|\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}"
                r"|\\begin\{align\*?\}(.*?)\\end\{align\*?\}")
# signs of a table, an equation and an image
TABLE_SIGN = r"(?i)<table[\s>/]"
EQUATION_SIGN = r"\$\$[^$]+\$\$|\$[^$]+\$"
IMAGE_SIGN = r"<img>.*?</img>"

# --- fixed values: texts of rendered documents ----------------------------------------------
NO_CSV = "No tables found or could not convert."
NO_TABLES = "No HTML tables found."
NO_EQUATIONS = "No LaTeX equations found."
NO_IMAGES = "No image descriptions found."
NO_WATERMARKS = "No watermarks found."
NO_PAGE_NUMBERS = "No page numbers found."
NO_ITEMS = "No tables found."
ITEM_HEADER = ["Description", "Quantity", "Unit Price", "Total"]
PREVIEW_HEAD = ('<div style="font-family: Arial, sans-serif; padding: 20px; background: #f5f5f5; border-radius: 8px;">\n'
                '<h2 style="color: #333; border-bottom: 2px solid #4CAF50; padding-bottom: 10px;">📄 Document Preview</h2>')
PREVIEW_BLOCK = '<div style="background: white; padding: 15px; border-radius: 5px; margin-top: 15px;">\n<h3>Page '
PREVIEW_BODY = '</h3>\n<div style="line-height: 1.6;">'

# --- fixed values: where a schema field's value may stand, from the field's spelling and the type's pattern ---
SAME_LINE = r"{spelling}\s*[:\-=]\s*({kind})"
NEXT_LINE = r"{spelling}\s*\n\s*({kind})"
