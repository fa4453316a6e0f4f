"""Fixed values that results depend on: categories, keywords, senders, phrases.

Everything in this module is data, kept in the order in which rules apply
(first match wins wherever an order matters).
"""

from __future__ import annotations

DEFAULT_CURRENCY = "INR"
TYPES = ("income", "expense")
SOURCES = ("manual", "screenshot", "import", "sms")

# Category id -> name, per type; the last entry is the default.
EXPENSE_CATEGORIES = {
    "food": "Food",
    "transport": "Transport",
    "shopping": "Shopping",
    "bills": "Bills",
    "entertainment": "Entertainment",
    "health": "Health",
    "education": "Education",
    "travel": "Travel",
    "personal": "Personal",
    "other": "Other",
}
INCOME_CATEGORIES = {
    "salary": "Salary",
    "freelance": "Freelance",
    "business": "Business",
    "investment": "Investment",
    "gift": "Gift",
    "other_income": "Other",
}

# Category keywords of expenses.
EXPENSE_KEYWORDS = {
    "food": (
        "swiggy", "zomato", "restaurant", "hotel", "cafe", "coffee", "tea", "chai", "bakery", "mcdonald",
        "starbucks", "kfc", "burger", "pizza", "domino", "subway", "food", "dining", "eatery", "dhaba", "kitchen",
        "biryani", "sweets", "bar", "pub", "bistro", "snacks", "canteen",
    ),
    "transport": (
        "uber", "ola", "rapido", "metro", "fuel", "petrol", "diesel", "hpcl", "bpcl", "ioc", "indian oil", "auto",
        "cab", "taxi", "toll", "fastag", "parking", "railway", "irctc", "bus", "redbus", "transport",
    ),
    "shopping": (
        "amazon", "flipkart", "myntra", "meesho", "ajio", "blinkit", "zepto", "instamart", "bigbasket",
        "supermarket", "mart", "mall", "store", "retail", "grocery", "apparel", "clothing", "fashion", "shopping",
        "decathlon", "zara", "h&m",
    ),
    "bills": (
        "electricity", "bescom", "tneb", "water", "wifi", "broadband", "recharge", "airtel", "jio", "vi", "vodafone",
        "gas", "cylinder", "bill", "utility", "rent", "maintenance", "dth", "tata play", "insurance", "lic",
    ),
    "entertainment": (
        "netflix", "spotify", "prime", "hotstar", "disney", "youtube", "movie", "cinema", "pvr", "inox",
        "bookmyshow", "games", "playstation", "steam", "theatre", "concert",
    ),
    "health": (
        "pharmacy", "hospital", "clinic", "medicine", "medical", "doctor", "apollo", "1mg", "pharmeasy", "medplus",
        "lab", "dental", "health", "diagnostic", "therapy", "opticals",
    ),
    "education": (
        "school", "college", "tuition", "course", "books", "fees", "university", "udemy", "coursera", "training",
        "exam", "academy", "class",
    ),
    "travel": (
        "flight", "airline", "indigo", "air india", "hotel", "makemytrip", "mmt", "booking.com", "agoda", "resort",
        "trip", "vacation", "tour", "airbnb",
    ),
    "personal": (
        "salon", "spa", "haircut", "parlour", "beauty", "cosmetics", "nykaa", "grooming", "personal", "massage",
    ),
}

# Category keywords of income.
INCOME_KEYWORDS = {
    "salary": (
        "salary", "payroll", "wage", "stipend", "bonus", "earnings", "employer", "payout",
    ),
    "freelance": (
        "freelance", "client", "consulting", "contract", "upwork", "fiverr", "gig",
    ),
    "business": (
        "revenue", "sales", "customer", "invoice", "vendor", "merchant payment", "business", "settlement",
    ),
    "investment": (
        "dividend", "interest", "stock", "zerodha", "groww", "mutual fund", "crypto", "returns", "deposit", "fd",
        "rd",
    ),
    "gift": (
        "gift", "cashback", "reward", "prize", "lottery", "donation", "received from",
    ),
}

# Message sender codes, in match order.
SENDER_CODES = {
    "HDFCBK": "HDFC Bank",
    "HDFC": "HDFC Bank",
    "SBINB": "State Bank of India",
    "SBIINB": "State Bank of India",
    "SBIPAY": "State Bank of India",
    "SBISMS": "State Bank of India",
    "SBIUPI": "State Bank of India",
    "SBI": "State Bank of India",
    "ICICIB": "ICICI Bank",
    "ICICI": "ICICI Bank",
    "AXISBK": "Axis Bank",
    "AXIS": "Axis Bank",
    "KOTAKB": "Kotak Mahindra Bank",
    "KOTAK": "Kotak Mahindra Bank",
    "PNBSMS": "Punjab National Bank",
    "PNB": "Punjab National Bank",
    "BOBSMS": "Bank of Baroda",
    "BOB": "Bank of Baroda",
    "CANBNK": "Canara Bank",
    "CANARA": "Canara Bank",
    "UNIONB": "Union Bank of India",
    "UBI": "Union Bank of India",
    "YESBNK": "Yes Bank",
    "YESBANK": "Yes Bank",
    "IDFCFB": "IDFC FIRST Bank",
    "IDFC": "IDFC FIRST Bank",
    "INDUSB": "IndusInd Bank",
    "INDUS": "IndusInd Bank",
    "PAYTM": "Paytm",
    "PYTM": "Paytm",
    "AIRTEL": "Airtel Payments Bank",
    "AIRBNK": "Airtel Payments Bank",
    "JUPITR": "Jupiter",
    "FIMONY": "Fi Money",
    "CRED": "CRED",
    "GPAY": "Google Pay",
    "PHONPE": "PhonePe",
    "PHONEPE": "PhonePe",
    "JIOPAY": "JioPay",
    "RBLBNK": "RBL Bank",
    "RBL": "RBL Bank",
    "FEDERAL": "Federal Bank",
    "FEDBNK": "Federal Bank",
    "AUBANK": "AU Small Finance Bank",
    "AUFINA": "AU Small Finance Bank",
}

# Bank names looked for in the message text when the sender says nothing.
BODY_BANK_WORDS = {
    "hdfc": "HDFC Bank",
    "sbi": "State Bank of India",
    "state bank": "State Bank of India",
    "icici": "ICICI Bank",
    "axis": "Axis Bank",
    "kotak": "Kotak Mahindra Bank",
    "punjab national": "Punjab National Bank",
    "pnb": "Punjab National Bank",
    "bank of baroda": "Bank of Baroda",
    "bob": "Bank of Baroda",
    "canara": "Canara Bank",
    "union bank": "Union Bank of India",
    "idfc": "IDFC FIRST Bank",
    "yes bank": "Yes Bank",
    "indusind": "IndusInd Bank",
    "paytm": "Paytm",
    "google pay": "Google Pay",
    "gpay": "Google Pay",
    "phonepe": "PhonePe",
}

# Phrases of one-time-password messages and of promotions.
OTP_PHRASES = (
    "otp",
    "one time password",
    "verification code",
    "security code",
    "secret code",
    "do not share",
)
PROMOTION_PHRASES = (
    "apply now",
    "apply for",
    "pre-approved loan",
    "pre-approved",
    "pre approved",
    "get personal loan",
    "personal loan",
    "instant loan",
    "loan up to",
    "congratulations! you are eligible",
    "congratulations",
    "upgrade your card",
    "credit limit of rs",
    "increase your limit",
    "credit card offer",
    "zero interest loan",
    "claim reward",
    "claim your",
    "reward points",
    "rewards point",
    "redeem points",
    "cashback offer",
    "earn cashback",
    "flat off",
    "voucher",
    "coupon",
    "promo code",
    "win up to",
    "chance to win",
    "lucky winner",
    "lottery",
    "bonus credited",
    "wallet bonus",
    "recharge now",
    "pack expiring",
    "plan expires",
    "plan expired",
    "dont miss",
    "don't miss",
    "offer valid",
    "hurry",
    "click here",
    "click on",
    "tap here",
    "download the app",
    "visit http",
    "bit.ly",
)
DEFAULT_EXCLUDED_KEYWORDS = (
    "loan",
    "pre-approved",
    "bonus",
    "voucher",
    "coupon",
    "recharge",
    "rummy",
    "win",
    "lottery",
    "cashback offer",
)

# The cheap prefilter for live messages.
LIKELY_ACTIONS = (
    "debited",
    "credited",
    "spent",
    "paid",
    "sent",
    "withdrawn",
    "transferred",
    "purchase",
    "received",
    "deposited",
    "refund",
    "cashback",
    "deducted",
    "charged",
)
LIKELY_MARKS = ("rs", "inr", "₹", "usd", "eur")
LIKELY_OTP = ("otp", "verification code", "secret code", "one time password", "do not share")
