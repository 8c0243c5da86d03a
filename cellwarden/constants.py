"""Word lists, patterns, thresholds and labels of the rules.

Everything here is data, not logic. Results depend on each entry exactly, so
the lists are kept together and in their natural order.
"""

# --- Fixed values: missing-value tokens (compared after strip + lower) -----
PROFILE_NULL_TOKENS = (
    "", "n/a", "na", "null", "none", "nan", "-", "--", "?", "#n/a",
    "missing", "unknown", "n.a.",
)
DETECTOR_NULL_TOKENS = PROFILE_NULL_TOKENS + ("n/d",)
FD_NULL_TOKENS = ("", "n/a", "na", "null", "none", "nan", "-", "--", "?", "#n/a")

# --- Fixed values: whitespace code points removed by ``strip`` -------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# --- Fixed values: semantic patterns, in tie-break order -------------------
SEMANTIC_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\+]?[\d\s\-\(\)\.]{7,20}$",
    "url": r"^https?://[^\s]+$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_dmy": r"^\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}$",
    "currency": r"^[\$€£¥₫]\s?[\d,]+\.?\d*$",
    "percentage": r"^\d+\.?\d*\s?%$",
    "uuid": r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "zipcode_us": r"^\d{5}(-\d{4})?$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "credit_card": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
}
PII_PATTERN_NAMES = ("email", "phone", "ssn", "credit_card")
SEMANTIC_MIN_RATE = 0.5
PII_MIN_RATE = 0.3

# --- Fixed values: column-name hints, first hit wins -----------------------
SEMANTIC_NAME_HINTS = (
    ("email", "email"), ("mail", "email"),
    ("phone", "phone"), ("tel", "phone"), ("mobile", "phone"),
    ("url", "url"), ("website", "url"), ("link", "url"),
    ("date", "date"), ("created", "date"), ("updated", "date"),
    ("birth", "date"), ("dob", "date"),
    ("price", "currency"), ("cost", "currency"), ("amount", "currency"),
    ("salary", "currency"), ("income", "currency"),
    ("zip", "zipcode"), ("postal", "zipcode"),
    ("ip", "ip_address"),
    ("id", "identifier"), ("uuid", "identifier"), ("key", "identifier"),
)
NAME_HINT_CONFIDENCE = 0.7
PII_NAME_KEYWORDS = (
    "name", "first_name", "last_name", "fullname", "full_name",
    "email", "phone", "mobile", "address", "street", "ssn",
    "social_security", "passport", "license", "dob", "birth",
    "salary", "income", "credit_card", "card_number", "password",
)
PII_NAME_LIKELIHOOD = 0.6

# --- Fixed values: date formats, first match wins --------------------------
DATE_FORMATS = (
    ("DD/MM/YYYY or MM/DD/YYYY", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("DD-MM-YYYY", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("DD.MM.YYYY", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("YYYY-MM-DD (ISO)", r"^\d{4}-\d{2}-\d{2}$"),
    ("YYYY/MM/DD", r"^\d{4}/\d{2}/\d{2}$"),
    ("DD/MM/YY", r"^\d{1,2}/\d{1,2}/\d{2}$"),
)
INTEGER_PATTERN = r"^-?\d+$"
FLOAT_PATTERN = r"^-?\d+\.?\d*$"

# --- Fixed values: detector thresholds -------------------------------------
RARE_SHAPE_SHARE = 0.05
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
DOMINANT_TYPE_SHARE = 0.8
SIMILARITY_MIN = 0.85
NEAR_DUP_MAX_DISTINCT = 500
KEY_NAME_HINTS = ("id", "key", "code", "number", "mã", "stt")
FD_MIN_CONFIDENCE = 0.90
FD_MIN_GROUP = 3
FD_MIN_COVERAGE = 0.3
FD_MAX_SHARE = 0.9

# --- Fixed values: sensitive column and table names ------------------------
FINANCIAL_KEYWORDS = (
    "amount", "price", "cost", "salary", "income", "revenue", "profit",
    "balance", "total", "payment", "transaction", "refund", "invoice",
    "credit", "debit", "fee", "charge", "tax", "budget", "expenditure",
)
SENSITIVE_KEYWORDS = (
    "ssn", "password", "secret", "token", "private_key",
    "credit_card", "account_number", "bank",
)
FINANCIAL_TABLE_KEYWORDS = (
    "transaction", "payment", "invoice", "salary", "payroll",
    "financial", "accounting", "billing", "ledger",
)

# --- Fixed values: detectors in registration order -------------------------
DETECTORS = (
    "null_detector",
    "disguised_null_detector",
    "whitespace_detector",
    "date_format_detector",
    "pattern_rarity_detector",
    "outlier_detector",
    "type_mismatch_detector",
    "near_duplicate_detector",
    "duplicate_key_detector",
    "fd_violation_detector",
    "high_value_data_detector",
)

# --- Fixed values: enumerations --------------------------------------------
REVIEW_ACTIONS = ("APPROVE", "EDIT", "REJECT")
HIGH_IMPACT_ACTIONS = ("delete_row", "delete_column", "modify_schema", "verify_authority")
MEDIUM_IMPACT_ACTIONS = ("change_value", "merge_records")
MAX_CONFLICT = 0.3
MAX_IGNORANCE = 0.4
MASS_EPSILON = 1e-6

# --- Fixed values: table domains (id, name, entity, keywords) --------------
DOMAINS = (
    ("hr_payroll",
     "Quản lý Nhân sự & Bảng lương Doanh nghiệp (Enterprise HR & Payroll)",
     "Hồ sơ Nhân viên / Cán bộ nhân sự",
     ("salary", "employee", "hire_date", "department", "staff", "luong", "nhan_vien",
      "phong_ban", "job_title", "bank_account", "tax_id")),
    ("finance_accounting",
     "Báo cáo Tài chính & Sổ cái Kế toán (Financial Ledger & Accounting)",
     "Bút toán Giao dịch Tài chính / Chứng từ Kế toán",
     ("balance", "amount", "transaction", "debit", "credit", "ledger", "so_du", "so_tien",
      "giao_dich", "tai_khoan", "invoice", "hoa_don")),
    ("ecommerce_sales",
     "Bán hàng & Thương mại Điện tử (Sales & E-Commerce Orders)",
     "Đơn đặt hàng / Giao dịch Mua bán",
     ("order", "customer", "product", "price", "quantity", "discount", "don_hang",
      "khach_hang", "san_pham", "gia", "so_luong")),
    ("logistics_supply",
     "Chuỗi Cung ứng & Kho vận (Supply Chain & Logistics)",
     "Kiện hàng Vận chuyển / Mục Tồn kho",
     ("tracking", "shipment", "warehouse", "inventory", "freight", "van_don", "kho_bai",
      "ton_kho", "supplier", "nha_cung_cap")),
    ("crm_customers",
     "Quản trị Quan hệ Khách hàng (CRM & Leads)",
     "Hồ sơ Khách hàng & Cơ hội Bán hàng",
     ("lead", "contact", "company", "stage", "deal", "pipeline", "email", "phone",
      "khach_hang_tiem_nang")),
    ("healthcare_medical",
     "Y tế & Hồ sơ Bệnh án (Healthcare & Patient Records)",
     "Hồ sơ Bệnh nhân / Lịch sử Khám chữa bệnh",
     ("patient", "diagnosis", "doctor", "prescription", "hospital", "benh_nhan", "bac_si",
      "chan_doan", "thuoc")),
)
GENERAL_DOMAIN = (
    "general_operations",
    "Dữ liệu Vận hành & Nghiệp vụ Tổ chức (Enterprise Operations)",
    "Bản ghi Nghiệp vụ Doanh nghiệp",
)
PRIMARY_KEY_NAMES = ("id", "code", "ma", "sku", "uuid", "key")
TIME_NAME_KEYWORDS = ("date", "time", "created", "at", "ngay", "timestamp")
SENSITIVE_NAME_KEYWORDS = (
    "salary", "luong", "bank", "account", "phone", "tax", "pass", "cccd", "cmnd",
)
NOT_FOUND = "Không xác định"

# --- Fixed values: issue classes of the report -----------------------------
ISSUE_NULL_WORDS = (
    "N/A", "NA", "-", "NULL", "NONE", "UNKNOWN", "CHUA_RO", "KHONG", "TRONG",
)
ISSUE_MONEY_KEYWORDS = ("salary", "luong", "price", "amount")

# --- Fixed values: column aliases of spoken edit commands ------------------
COLUMN_ALIASES = (
    ("lương", ("salary", "wage", "income", "compensation")),
    ("luong", ("salary", "wage", "income", "compensation")),
    ("tên", ("name", "full_name", "employee_name")),
    ("ten", ("name", "full_name", "employee_name")),
    ("email", ("email", "mail")),
    ("phòng", ("department", "dept")),
    ("phong", ("department", "dept")),
    ("ngày", ("date", "created_at", "joined_date")),
    ("ngay", ("date", "created_at", "joined_date")),
)
