"""Diuretic codes, names, routes, resistance limits and dose equivalents."""

# fixed values: infusion codes
MV_DRUGS = {228340: "furosemide", 221794: "furosemide"}
CV_DRUGS = {45275: "bumetanide", 46690: "bumetanide", 30123: "furosemide"}

# fixed values: prescription keywords in order of precedence
PRESCRIBED = {
    "furosemide": "furosemide",
    "torasemide": "torasemide",
    "torsemide": "torasemide",
    "bumetanide": "bumetanide",
    "ethacrynic acid": "ethacrynic acid",
    "lasix": "lasix",
}
ROUTES = {"iv": "IV", "po": "PO", "ng": "PO", "pb": "PO", "g tube": "G TUBE"}
CRITICAL_ROUTE = "G TUBE"
UNWANTED_DOSE_TEXT = ("-", "j20")

# fixed values: daily dose above which a patient counts as resistant; route None means any
RESISTANCE = (
    ("furosemide", "IV", 80),
    ("furosemide", "PO", 160),
    ("torasemide", None, 40),
    ("bumetanide", None, 2),
    ("ethacrynic acid", None, 100),
)

# fixed values: dose of one equivalent unit
EQUIVALENTS = (
    ("furosemide", "IV", 40),
    ("furosemide", "PO", 80),
    ("torasemide", None, 20),
    ("bumetanide", None, 2),
    ("ethacrynic acid", None, 50),
)
