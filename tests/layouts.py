"""Seven layouts on a screen of 900 x 1600, tokens as (text, x1, y1, x2, y2)."""

LAYOUTS = {
    "list": [("Swiggy", 50, 100, 200, 130), ("₹349.00", 700, 100, 820, 130), ("18 Sep 2026", 50, 140, 180, 165),
             ("Uber India Systems", 50, 250, 320, 280), ("₹185.00", 700, 250, 820, 280), ("17 Sep 2026", 50, 290, 180, 315)],
    "receipt1": [("Payment Successful", 100, 80, 400, 120), ("₹70", 350, 160, 480, 220), ("Paid to Shiva", 100, 250, 300, 280),
                 ("18 September 2026, 3:15 PM", 100, 310, 420, 340), ("Transaction ID: T260918151523456789", 100, 380, 500, 410)],
    "nosign": [("Payment successful", 60, 100, 350, 130), ("10", 60, 170, 130, 220), ("Paid to Safoora C H", 60, 250, 320, 280),
               ("18 Sep 2026, 11:20 AM", 60, 310, 360, 340), ("UPI Transaction ID: 004415604898", 60, 450, 450, 480)],
    "receipt2": [("Payment Done", 80, 100, 300, 130), ("₹50.00", 80, 160, 200, 210), ("To Delhi Metro Rail Corporation", 80, 230, 450, 260),
                 ("Order ID: 893489201934", 80, 300, 350, 330), ("18-09-2026", 80, 360, 220, 390)],
    "receipt3": [("Transaction Successful", 100, 100, 420, 130), ("₹2,500", 300, 170, 450, 220), ("Beneficiary: Ramesh Verma", 100, 250, 400, 280),
                 ("18 Sep 2026", 100, 310, 240, 340), ("RRN: 426189301923", 100, 370, 350, 400)],
    "statement": [("18-09-2026", 40, 120, 160, 150), ("UPI-STARBUCKS COFFEE-9923", 180, 120, 520, 150), ("- ₹450.00", 650, 120, 800, 150),
                  ("17-09-2026", 40, 240, 160, 270), ("NEFT-SALARY-TECHCORP", 180, 240, 500, 270), ("+ ₹65,000.00", 650, 240, 830, 270)],
    "unknown": [("Transfer Completed", 70, 100, 350, 130), ("LOVE YOU CHAI", 70, 160, 350, 200), ("₹36", 70, 220, 160, 270),
                ("18 September 2026", 70, 300, 320, 330), ("Txn ID: 994827163829", 70, 370, 380, 400)],
}
EXPECTED = {
    "list": [(34900, "Swiggy", "expense"), (18500, "Uber India Systems", "expense")],
    "receipt1": [(7000, "Shiva", "expense")],
    "nosign": [(1000, "Safoora C H", "expense")],
    "receipt2": [(5000, "Delhi Metro Rail Corporation", "expense")],
    "receipt3": [(250000, "Ramesh Verma", "expense")],
    "statement": [(45000, ..., "expense"), (6500000, ..., "income")],
    "unknown": [(3600, "LOVE YOU CHAI", "expense")],
}

TOKEN_SCHEMA = (
    "image_id string, token_no long, text string, text_normalized string, confidence double, score double, "
    "min_x double, min_y double, max_x double, max_y double, cx double, cy double, width double, height double"
)


def token(image, no, text, x1, y1, x2, y2, score=0.95, width=900.0, height=1600.0):
    return (image, no, text, text, score, score, float(x1), float(y1), float(x2), float(y2), (x1 + x2) / 2.0, (y1 + y2) / 2.0, width, height)


def layout_rows():
    return [token(name, i, *spec) for name, specs in LAYOUTS.items() for i, spec in enumerate(specs)]
