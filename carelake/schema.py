"""Stored-table schemas and the fixed values the cleaning rules depend on."""

from __future__ import annotations

from pyspark.sql import types as T

PATIENT_SCHEMA = T.StructType([
    T.StructField("patient_id", T.LongType(), False),
    T.StructField("first_name", T.StringType(), False),
    T.StructField("last_name", T.StringType(), False),
    T.StructField("gender", T.StringType(), True),
    T.StructField("date_of_birth", T.DateType(), True),
    T.StructField("phone_number", T.StringType(), False),
    T.StructField("email", T.StringType(), True),
    T.StructField("address", T.StringType(), True),
    T.StructField("blood_group", T.StringType(), True),
    T.StructField("registration_date", T.DateType(), False),
])

VISIT_SCHEMA = T.StructType([
    T.StructField("visit_id", T.LongType(), False),
    T.StructField("patient_id", T.LongType(), False),
    T.StructField("doctor_name", T.StringType(), False),
    T.StructField("symptoms", T.StringType(), True),
    T.StructField("medications", T.StringType(), True),
    T.StructField("follow_up_date", T.DateType(), True),
    T.StructField("visit_date", T.DateType(), False),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("audit_id", T.LongType(), False),
    T.StructField("entity_type", T.StringType(), False),
    T.StructField("entity_id", T.LongType(), True),
    T.StructField("action", T.StringType(), False),
    T.StructField("changed_by", T.StringType(), False),
    T.StructField("changed_at", T.TimestampNTZType(), False),
    T.StructField("details", T.StringType(), True),
])

PATIENT_COLUMNS = [f.name for f in PATIENT_SCHEMA.fields]
VISIT_COLUMNS = [f.name for f in VISIT_SCHEMA.fields]
AUDIT_COLUMNS = [f.name for f in AUDIT_SCHEMA.fields]

# Columns written by the upload (import) path: no patient_id, new ids are assigned.
CANONICAL_COLUMNS = PATIENT_COLUMNS[1:]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application's behaviour.
# ---------------------------------------------------------------------------

# Header aliases (normalised header text -> canonical column). The last block
# holds the aliases the mapping document promises for visit sheets.
COLUMN_ALIASES = {
    "patient id": "patient_id",
    "id": "patient_id",
    "first name": "first_name",
    "fname": "first_name",
    "last name": "last_name",
    "lname": "last_name",
    "sex": "gender",
    "dob": "date_of_birth",
    "date of birth": "date_of_birth",
    "birth date": "date_of_birth",
    "phone": "phone_number",
    "phone number": "phone_number",
    "mobile": "phone_number",
    "contact number": "phone_number",
    "email address": "email",
    "mail": "email",
    "home address": "address",
    "location": "address",
    "blood type": "blood_group",
    "registration date": "registration_date",
    "registered on": "registration_date",
    "name": "first_name",
    "blood group": "blood_group",
    "doctor": "doctor_name",
    "physician": "doctor_name",
    "complaint": "symptoms",
    "notes": "symptoms",
    "consultation date": "visit_date",
}

# Canonical patient columns a raw sheet is expected to carry (others are "unknown").
EXPECTED_PATIENT_COLUMNS = PATIENT_COLUMNS

# Columns the CLI pipeline requires; the visits pipeline requires its own pair.
REQUIRED_PATIENT_COLUMNS = ["first_name", "last_name", "phone_number", "date_of_birth"]
REQUIRED_VISIT_COLUMNS = ["doctor_name", "visit_date"]

# Characters stripped from both ends of a value (Python's str.isspace() set).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Placeholder texts treated as missing (compared case-insensitively after strip).
NULL_TOKENS = ["", "nan", "none", "nat"]

# Gender codes and the set the profiler accepts as consistent.
GENDER_CODES = {"m": "Male", "f": "Female", "o": "Other"}
ALLOWED_GENDER_VALUES = ["male", "female", "other", "m", "f", "o"]

# Day-first date layouts accepted per value, as (layout, shape, rewrite to y-M-d).
# Separators inside one value must agree; an optional time part must be valid.
TIME_PART = r"([ T]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?Z?)?"
DATE_LAYOUTS = [
    ("d-M-yyyy, d/M/yyyy, d.M.yyyy [HH:mm:ss]",
     r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + TIME_PART + "$", "$4-$3-$1"),
    ("yyyy-M-d, yyyy/M/d, yyyy.M.d [HH:mm:ss]",
     r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + TIME_PART + "$", "$1-$3-$4"),
    ("yyyyMMdd", r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    ("d/M/yy, d-M-yy, d.M.yy from 1970 to 1999", r"^(\d{1,2})([-/.])(\d{1,2})\2([7-9]\d)$", "19$4-$3-$1"),
    ("d/M/yy, d-M-yy, d.M.yy from 2000 to 2069", r"^(\d{1,2})([-/.])(\d{1,2})\2([0-6]\d)$", "20$4-$3-$1"),
]
# Month-name dates: day, month (short or full, any case), year; rewritten to y-MMM-d.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]
MONTH_NAME_SHAPE = (r"(?i)^(\d{1,2})[- /](" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
                    + r")\.?,?[- /](\d{4})" + TIME_PART + "$")
DATE_FORMATS = [name for name, _, _ in DATE_LAYOUTS]

# Triage rule.
HIGH_RISK_KEYWORDS = [
    "chest pain", "breathless", "breathing", "stroke", "severe", "unconscious", "high fever",
]
TRIAGE_AGE_THRESHOLD = 60

# Fuzzy duplicate rule: both name similarities at least this ratio.
FUZZY_NAME_THRESHOLD = 0.88

# Minimum digits for a usable phone number.
MIN_PHONE_DIGITS = 5

# Validation messages.
MSG_MISSING_FIRST = "Missing first name"
MSG_MISSING_LAST = "Missing last name"
MSG_BAD_PHONE = "Invalid or missing phone number (min 5 digits)"
MSG_DUP_PHONE = "Duplicate phone number"
MSG_DUP_EMAIL = "Duplicate email address"
MSG_BAD_EMAIL = "Invalid email format"
MSG_BAD_DOB = "Invalid date of birth format"
MSG_DUPLICATE_VALUE = "Duplicate value detected. Phone number or email already exists."
MSG_UNKNOWN_PATIENT = "Patient not found"

# Reasons of this library's own, for rows the application refuses without a fixed text.
MSG_MISSING_PHONE = "Missing phone number"
MSG_MISSING_DOCTOR = "Missing doctor name"
MSG_BAD_VISIT_DATE = "Invalid or missing visit date"
MSG_UNRESOLVED_PATIENT = "Patient could not be resolved"
MSG_BAD_TIMESTAMP = "Invalid timestamp"
MSG_UNKNOWN_KIND = "Unknown record kind"

# API length bounds (min, max) per field.
FIELD_LENGTH_BOUNDS = {
    "first_name": (1, 50),
    "last_name": (1, 50),
    "gender": (0, 10),
    "phone_number": (5, 15),
    "email": (0, 100),
    "address": (0, 255),
    "blood_group": (0, 5),
    "doctor_name": (1, 100),
}

# Display defaults.
UNKNOWN_PATIENT_NAME = "Unknown patient"
UNKNOWN_DOCTOR = "Unknown"
NO_DIAGNOSIS = "No diagnosis data available."
WEEKDAY_ORDER = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
