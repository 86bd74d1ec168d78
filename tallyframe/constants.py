"""Fixed values that results depend on: word lists, tables, thresholds.

They are contract values of the domain and are stated here in natural order.
"""

from __future__ import annotations

# Chart of accounts (code, name, type, normal balance).
CHART_OF_ACCOUNTS = [
    ("1000", "Cash", "Asset", "Debit"),
    ("1100", "Accounts Receivable", "Asset", "Debit"),
    ("1200", "Inventory", "Asset", "Debit"),
    ("1300", "Prepaid Expenses", "Asset", "Debit"),
    ("1500", "Equipment", "Asset", "Debit"),
    ("1600", "Furniture", "Asset", "Debit"),
    ("1700", "Computer & Software", "Asset", "Debit"),
    ("1800", "Accumulated Depreciation", "Asset", "Credit"),
    ("2000", "Accounts Payable", "Liability", "Credit"),
    ("2100", "Accrued Expenses", "Liability", "Credit"),
    ("2200", "Short-term Debt", "Liability", "Credit"),
    ("2300", "Taxes Payable", "Liability", "Credit"),
    ("2500", "Long-term Debt", "Liability", "Credit"),
    ("3000", "Owner's Equity", "Equity", "Credit"),
    ("3100", "Retained Earnings", "Equity", "Credit"),
    ("4000", "Sales Revenue", "Revenue", "Credit"),
    ("4100", "Service Revenue", "Revenue", "Credit"),
    ("4200", "Other Revenue", "Revenue", "Credit"),
    ("5000", "Cost of Goods Sold", "Expense", "Debit"),
    ("5100", "Salaries & Wages", "Expense", "Debit"),
    ("5200", "Rent Expense", "Expense", "Debit"),
    ("5300", "Utilities Expense", "Expense", "Debit"),
    ("5400", "Marketing Expense", "Expense", "Debit"),
    ("5500", "Professional Services", "Expense", "Debit"),
    ("5600", "Travel Expense", "Expense", "Debit"),
    ("5700", "Office Supplies", "Expense", "Debit"),
    ("5800", "Insurance Expense", "Expense", "Debit"),
    ("5900", "Other Expenses", "Expense", "Debit"),
]

# Expense category -> account; anything else posts to 5900.
EXPENSE_ACCOUNTS = {
    "Office": "5700",
    "Rent": "5200",
    "Utilities": "5300",
    "Marketing": "5400",
    "Professional": "5500",
    "Travel": "5600",
    "Insurance": "5800",
    "Equipment": "1500",
    "Software": "1700",
}
DEFAULT_EXPENSE_ACCOUNT = "5900"
CASH_ACCOUNT = "1000"

# Default budgets (category, monthly, yearly, priority).
DEFAULT_BUDGETS = [
    ("Office", 500, 6000, "medium"),
    ("Software", 200, 2400, "high"),
    ("Utilities", 300, 3600, "high"),
    ("Marketing", 1000, 12000, "medium"),
    ("Professional", 800, 9600, "medium"),
    ("Equipment", 400, 4800, "low"),
    ("Travel", 600, 7200, "low"),
    ("Other", 300, 3600, "low"),
]

# Asset and liability keyword groups, tested in this order.
ASSET_LIABILITY_RULES = [
    (["equipment", "computer", "hardware"], "asset:Equipment"),
    (["office", "furniture", "supplies"], "asset:Office"),
    (["software", "license", "subscription"], "asset:Software"),
    (["vehicle", "car", "transport"], "asset:Vehicle"),
    (["property", "real estate", "building"], "asset:Property"),
    (["investment", "stock", "bond"], "asset:Investment"),
    (["cash", "bank", "savings"], "asset:Cash"),
    (["loan", "debt", "credit"], "liability:Debt"),
    (["rent", "lease"], "liability:Rent/Lease"),
    (["tax", "vat", "gst"], "liability:Tax"),
    (["insurance", "premium"], "liability:Insurance"),
    (["utility", "electric", "water", "internet"], "liability:Utilities"),
]

# Tax keyword groups in order, with type and default rate.
TAX_RULES = [
    (["vat", "value added tax", "gst"], "VAT by text"),
    (["income tax", "paye", "withholding"], "Income Tax"),
    (["corporate tax", "corporation tax", "company tax"], "Corporate Tax"),
    (["property tax", "council tax", "rates"], "Property Tax"),
    (["social security", "national insurance", "ni"], "Social Security"),
]
TAX_DEFAULT_RATES = {
    "VAT by text": 0.19,
    "Income Tax": 0.20,
    "Corporate Tax": 0.25,
    "Property Tax": 0.05,
    "Social Security": 0.12,
}
TAX_CATEGORY_RATES = {"VAT": 0.19, "Tax": 0.20}

# Sign keywords.
INCOME_WORDS = [
    "payment", "client", "customer", "revenue", "income", "sale", "invoice", "receipt", "earnings", "profit",
    "fee", "commission", "royalty", "rent", "interest", "dividend", "refund", "credit", "deposit",
]
EXPENSE_WORDS = [
    "expense", "cost", "bill", "purchase", "buy", "rent", "salary", "wage", "supplies", "equipment", "office",
    "marketing", "advertising", "travel", "utilities", "insurance", "tax", "fee", "charge", "debit",
]
INCOME_CATEGORY_WORDS = ["income", "revenue", "payment", "fee"]

# Currencies the rules accept, and the currencies the converter knows.
INVOICE_CURRENCIES = ["EUR", "USD", "GBP", "JPY", "SAR", "AED", "EGP", "QAR", "KWD", "BHD"]
SUPPORTED_CURRENCIES = ["EUR", "USD", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY"]

# Rules a patch may repair.
FIXABLE_RULES = [
    "arithmetic_balance", "line_sum_subtotal", "line_sum_tax", "date_format", "currency_format",
    "tax_coherence", "rounding_policy",
]

# Decision thresholds of the invoice path.
FIELD_CONFIDENCE_MIN = 0.82
CATEGORY_CONFIDENCE_MIN = 0.75
ARITHMETIC_TOLERANCE = 0.02
CURRENCY_DECIMALS = 2
DUPLICATE_WINDOW_DAYS = 180

# Report confidence weights per module.
REPORT_WEIGHTS = {"cash": 0.8, "budget": 0.7, "assets": 0.6, "debts": 0.7, "tax": 0.8, "forecast": 0.5}

# Advice categories and titles by query words, in order.
ADVICE_CATEGORIES = [
    (["tax", "vat"], "tax_planning"),
    (["budget", "expense"], "budget_optimization"),
    (["cash", "flow"], "cash_flow_management"),
    (["revenue", "income"], "revenue_optimization"),
    (["compliance", "audit"], "compliance"),
]
ADVICE_TITLES = [
    (["tax", "vat"], "Tax Optimization Advice"),
    (["budget", "expense"], "Budget Management Advice"),
    (["cash", "flow", "liquidity"], "Cash Flow Management"),
]

# First-match category words, in order (three variants).
CATEGORY_BASIC = [
    (["vat", "tax"], "Tax"),
    (["transaction", "fee"], "Transaction Fees"),
    (["service"], "Service Fees"),
    (["software", "license"], "Software"),
    (["office", "supplies"], "Office"),
    (["equipment", "hardware"], "Equipment"),
    (["travel", "transport"], "Travel"),
    (["marketing", "advertising"], "Marketing"),
    (["utility", "electric", "internet"], "Utilities"),
    (["professional", "consulting"], "Professional"),
    (["insurance", "premium"], "Insurance"),
    (["rent", "lease"], "Rent"),
    (["loan", "debt"], "Debt"),
]
CATEGORY_FALLBACK = [
    (["transaction", "fee", "query"], "Transaction Fees"),
    (["vat", "tax", "gst"], "Tax"),
    (["service", "maintenance", "support"], "Service Fees"),
    (["office", "supplies", "stationery"], "Office"),
    (["software", "license", "subscription"], "Software"),
    (["travel", "flight", "hotel", "transport"], "Travel"),
    (["marketing", "advertising", "promotion"], "Marketing"),
    (["utilities", "electric", "water", "internet"], "Utilities"),
    (["legal", "consulting", "professional"], "Professional"),
    (["equipment", "hardware", "computer"], "Equipment"),
]
CATEGORY_SERVER = [
    (["transaction", "fee"], "Transaction Fees"),
    (["vat", "tax"], "Tax"),
    (["service"], "Service Fees"),
    (["software", "license"], "Software"),
    (["office", "supplies"], "Office Supplies"),
]

# Ledger categories with their display names and their English and Arabic words.
GL_NAMES = {
    "office_supplies": "Office Supplies",
    "software": "Software & Licenses",
    "travel": "Travel & Transportation",
    "meals": "Meals & Entertainment",
    "utilities": "Utilities",
    "rent": "Rent & Facilities",
    "marketing": "Marketing & Advertising",
    "professional_services": "Professional Services",
    "equipment": "Equipment & Hardware",
    "training": "Training & Education",
    "insurance": "Insurance",
    "legal": "Legal & Compliance",
    "taxes": "Taxes & Fees",
    "banking": "Banking & Finance",
    "telecommunications": "Telecommunications",
    "maintenance": "Maintenance & Repairs",
    "other": "Other Expenses",
}
GL_WORDS = {
    "office_supplies": (
        "pen|pencil|paper|notebook|folder|stapler|clip|envelope|stamp|ink|toner|printer|scanner|desk|chair|office",
        "مكتب|ورق|قلم|مجلد|مشبك|مظروف|طابع|حبر|طابعة|ماسح|مكتب|كرسي",
    ),
    "software": (
        "software|license|subscription|saas|cloud|microsoft|adobe|google|aws|azure|slack|zoom|teams",
        "برنامج|ترخيص|اشتراك|سحابي|مايكروسوفت|أدوبي|جوجل|أمازون|أزور|سلاك|زووم|تيمز",
    ),
    "travel": (
        "travel|flight|hotel|taxi|uber|lyft|car rental|gas|fuel|parking|toll|airline|train|bus",
        "سفر|طيران|فندق|تاكسي|أوبر|ليفت|إيجار سيارة|بنزين|وقود|موقف|طريق|قطار|حافلة",
    ),
    "meals": (
        "meal|food|restaurant|lunch|dinner|breakfast|catering|coffee|tea|snack|dining",
        "وجبة|طعام|مطعم|غداء|عشاء|فطور|تجهيز|قهوة|شاي|وجبة خفيفة|طعام",
    ),
    "utilities": (
        "electricity|water|gas|internet|phone|electric|utility|power|energy|broadband",
        "كهرباء|ماء|غاز|إنترنت|هاتف|كهربائي|مرافق|طاقة|طاقة|نطاق عريض",
    ),
    "rent": (
        "rent|lease|office|space|facility|building|warehouse|storage|property|real estate",
        "إيجار|عقد|مكتب|مساحة|مرفق|مبنى|مستودع|تخزين|عقار|عقارات",
    ),
    "marketing": (
        "marketing|advertising|promotion|campaign|social media|facebook|instagram|twitter|linkedin|google ads",
        "تسويق|إعلان|ترويج|حملة|وسائل التواصل|فيسبوك|إنستغرام|تويتر|لينكد إن|إعلانات جوجل",
    ),
    "professional_services": (
        "consulting|legal|accounting|audit|lawyer|accountant|consultant|advisor|expert|specialist",
        "استشارات|قانوني|محاسبة|مراجعة|محامي|محاسب|مستشار|خبير|متخصص",
    ),
    "equipment": (
        "computer|laptop|server|monitor|keyboard|mouse|hardware|equipment|machine|device|tool",
        "كمبيوتر|لابتوب|خادم|شاشة|لوحة مفاتيح|فأرة|أجهزة|معدات|آلة|جهاز|أداة",
    ),
    "training": (
        "training|course|education|seminar|workshop|conference|learning|certification|skill|development",
        "تدريب|دورة|تعليم|ندوة|ورشة|مؤتمر|تعلم|شهادة|مهارة|تطوير",
    ),
    "insurance": (
        "insurance|coverage|policy|premium|claim|liability|health|property|business|auto",
        "تأمين|تغطية|بوليصة|قسط|مطالبة|مسؤولية|صحة|ممتلكات|عمل|سيارة",
    ),
    "legal": (
        "legal|law|court|litigation|contract|agreement|compliance|regulation|patent|trademark",
        "قانوني|قانون|محكمة|تقاضي|عقد|اتفاق|امتثال|تنظيم|براءة اختراع|علامة تجارية",
    ),
    "taxes": (
        "tax|vat|gst|income tax|property tax|sales tax|tax return|filing|audit|penalty",
        "ضريبة|ضريبة القيمة المضافة|ضريبة الدخل|ضريبة الممتلكات|ضريبة المبيعات|إقرار ضريبي|تقديم|مراجعة|غرامة",
    ),
    "banking": (
        "bank|banking|loan|credit|interest|fee|charge|transfer|payment|finance|financial",
        "بنك|مصرف|قرض|ائتمان|فائدة|رسوم|تحويل|دفع|مالي|مالية",
    ),
    "telecommunications": (
        "phone|mobile|telecom|internet|broadband|data|roaming|sim|network|connection",
        "هاتف|جوال|اتصالات|إنترنت|نطاق عريض|بيانات|تجوال|شريحة|شبكة|اتصال",
    ),
    "maintenance": (
        "maintenance|repair|service|fix|upgrade|installation|cleaning|janitorial|plumbing|electrical",
        "صيانة|إصلاح|خدمة|إصلاح|ترقية|تركيب|تنظيف|حراسة|سباكة|كهربائية",
    ),
}

# Field labels by language.
FIELD_LABELS = {
    "total": [
        "total", "grand total", "amount due", "net total", "final total", "amount", "sum", "subtotal",
        "total amount", "invoice total", "الإجمالي", "المجموع", "المبلغ الإجمالي", "المبلغ المستحق",
        "المبلغ النهائي", "المبلغ الصافي", "إجمالي الفاتورة",
    ],
    "tax": [
        "tax", "vat", "gst", "sales tax", "tax amount", "tax total", "value added tax", "taxable amount", "tax rate",
        "ضريبة", "ضريبة القيمة المضافة", "ضريبة المبيعات", "مبلغ الضريبة", "إجمالي الضريبة", "نسبة الضريبة",
        "المبلغ الخاضع للضريبة",
    ],
    "discount": [
        "discount", "deduction", "rebate", "discount amount", "discount total", "reduction", "off", "less", "minus",
        "خصم", "تخفيض", "خصم المبلغ", "إجمالي الخصم", "ناقص", "أقل",
    ],
    "shipping": [
        "shipping", "delivery", "freight", "transport", "shipping cost", "delivery fee", "freight charge",
        "shipping fee", "الشحن", "التوصيل", "الشحن والتوصيل", "رسوم الشحن", "تكلفة الشحن",
    ],
    "invoice_number": [
        "invoice", "invoice no", "invoice number", "inv no", "inv number", "bill", "bill no", "bill number",
        "receipt", "receipt no", "فاتورة", "رقم الفاتورة", "فاتورة رقم", "إيصال", "رقم الإيصال",
    ],
    "date": [
        "date", "invoice date", "issue date", "billing date", "created", "due date", "payment due", "expiry",
        "valid until", "تاريخ", "تاريخ الفاتورة", "تاريخ الإصدار", "تاريخ الاستحقاق", "تاريخ الدفع", "صالح حتى",
        "تاريخ الانتهاء",
    ],
    "vendor": [
        "from", "vendor", "supplier", "company", "business", "seller", "merchant", "provider", "contractor",
        "من", "المورد", "المزود", "الشركة", "التاجر", "المقاول",
    ],
}
AMOUNT_FIELDS = ("total", "tax", "discount", "shipping", "subtotal")

# Fields that a document must have; without a match they stand without a value.
REQUIRED_FIELDS = ("total", "invoice_number", "date", "vendor")

# Currency marks per ISO code, first hit wins.
CURRENCY_MARKS = {
    "EUR": ["€", "EUR", "euro", "euros", "يورو"],
    "USD": ["$", "USD", "dollar", "dollars", "دولار"],
    "GBP": ["£", "GBP", "pound", "pounds", "جنيه"],
    "JPY": ["¥", "JPY", "yen", "ين"],
    "SAR": ["SAR", "riyal", "ريال"],
    "AED": ["AED", "dirham", "درهم"],
    "EGP": ["EGP", "pound", "جنيه مصري"],
    "QAR": ["QAR", "riyal", "ريال قطري"],
    "KWD": ["KWD", "dinar", "دينار"],
    "BHD": ["BHD", "dinar", "دينار بحريني"],
}

# Words that mark readable invoice text.
INVOICE_WORDS_STRICT = [
    "invoice", "invoice no", "amount", "vat", "total", "net", "gross", "rechnung", "betrag", "mwst", "summe",
    "netto", "brutto", "€", "$", "£", "¥", "currency", "payment", "terms",
]
INVOICE_WORDS = INVOICE_WORDS_STRICT + [
    "company", "gmbh", "ag", "ltd", "inc", "corp", "address", "phone", "email",
]

# Arabic letter blocks, and Arabic-Indic and Persian digits.
ARABIC_BLOCKS = (
    r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
)
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"

# Time-to-live multipliers by task.
TTL_MULTIPLIERS = {"extraction": 2.0, "categorization": 1.5, "validation": 1.0, "analysis": 0.5, "insights": 0.3}

# Softened phrases in health narratives.
SOFT_TAIL = "suggests underlying revenue-generating activity, though not captured in the data provided"
SOFT_PHRASES = [
    ("ability to cover expenses", SOFT_TAIL),
    ("indicates a functioning revenue stream", SOFT_TAIL),
    ("shows financial capacity", SOFT_TAIL),
    ("demonstrates financial health", SOFT_TAIL),
    ("proves", "suggests"),
    ("confirms", "indicates"),
    ("shows", "suggests"),
    ("demonstrates", "indicates"),
]
SOFT_STRONG_WORDS = "stable|good|excellent|outstanding|exceptional|strong|robust|promising|positive"
SOFT_STRONG_REPLACEMENT = "cannot be confirmed as stable"
