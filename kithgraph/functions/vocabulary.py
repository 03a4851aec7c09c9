"""Word lists, lookup tables and texts that must be as given for right results."""

PLACEHOLDERS = [
    "", "-", "--", "0", "na", "n/a", "n.a.", "none", "null", "nil", "nan", "unknown", "missing",
    "undefined", "not available", "notavailable", "test", "xxx",
]

STREET_WORDS = {
    "street": "st", "avenue": "ave", "road": "rd", "drive": "dr", "lane": "ln", "boulevard": "blvd",
    "court": "ct", "place": "pl", "apartment": "apt", "suite": "ste", "north": "n", "south": "s",
    "east": "e", "west": "w",
}

NON_ROUTABLE_IPS = ["0.0.0.0", "127.0.0.1", "::1", "255.255.255.255"]

POSITIVE_WORDS = [
    "1", "1.0", "true", "t", "yes", "y", "fraud", "fraudulent", "bad", "positive", "confirmed",
]
NEGATIVE_WORDS = [
    "0", "0.0", "false", "f", "no", "n", "legit", "legitimate", "genuine", "good", "normal",
    "negative", "clean", "not fraud", "notfraud", "non-fraud", "nonfraud",
]

ATTRIBUTE_SYNONYMS = {
    "phone": "phone", "phonenumber": "phone", "mobile": "phone", "cell": "phone",
    "telephone": "phone", "msisdn": "phone",
    "email": "email", "mail": "email", "emailaddress": "email",
    "address": "address", "addr": "address", "homeaddress": "address", "street": "address",
    "device": "device", "deviceid": "device", "fingerprint": "device", "devicefingerprint": "device",
    "ip": "ip", "ipaddress": "ip",
    "ssn": "national_id", "nationalid": "national_id", "taxid": "national_id", "passport": "national_id",
    "bank": "bank_account", "bankaccount": "bank_account", "iban": "bank_account",
    "card": "bank_account", "cardnumber": "bank_account",
}
ATTRIBUTE_PREFIXES = ["phone", "email", "address", "device"]

EVENT_SYNONYMS = {
    "purchase": "purchase", "purchases": "purchase", "spend": "purchase", "debit": "purchase",
    "transaction": "purchase", "txn": "purchase", "sale": "purchase",
    "payment": "payment", "repayment": "payment", "pay": "payment", "bill_payment": "payment",
    "credit_limit_increase": "credit_limit_increase", "limit_increase": "credit_limit_increase",
    "cli": "credit_limit_increase", "credit_line_increase": "credit_limit_increase",
}

ROLES = {
    "ignore": "Ignore",
    "customer_id": "Customer ID",
    "name": "Name",
    "label": "Fraud label",
    "ring": "Known ring ID (evaluation only)",
    "open_date": "Account open date",
    "feature": "Numeric feature",
    "phone": "Phone number",
    "email": "Email address",
    "address": "Address",
    "device": "Device ID / fingerprint",
    "ip": "IP address",
    "national_id": "National ID / SSN",
    "bank_account": "Bank account / card",
    "identifier": "Other shared identifier",
}
IDENTITY_ROLES = ["phone", "email", "address", "device", "ip", "national_id", "bank_account", "identifier"]
SINGLE_ROLES = ["customer_id", "label", "ring", "open_date"]
SENSITIVE_TYPES = ["national_id", "bank_account"]
CORE_TYPES = ["phone", "email", "address", "device"]

ID_NAMES = [
    "customerid", "custid", "clientid", "userid", "accountid", "applicantid", "applicationid", "memberid",
    "personid", "partyid", "customerno", "customernumber", "customerref", "id", "customer", "client",
]
LABEL_NAMES = [
    "issyntheticfraud", "isfraud", "fraud", "fraudflag", "fraudlabel", "label", "target", "class",
    "isfraudulent", "fraudulent", "y", "fraudindicator", "confirmedfraud",
]
RING_NAMES = ["ringid", "fraudringid", "ring", "ringlabel", "ringname", "fraudring"]
OPEN_DATE_NAMES = [
    "accountopendate", "opendate", "accountopened", "dateopened", "openeddate", "openedon", "opened",
    "accountopeningdate", "signupdate", "createdat", "createddate", "registrationdate", "registered",
    "applicationdate", "accountcreated", "joindate", "joined", "onboardingdate",
]
OPEN_DATE_TOKENS = ["open", "opened", "opening", "signup", "created", "registration", "registered"]
PERSON_NAMES = [
    "fullname", "name", "customername", "clientname", "applicantname", "firstname", "lastname", "givenname",
    "surname", "middlename", "accountholder", "holdername",
]
BIRTH_NAMES = ["dateofbirth", "dob", "birthdate", "birthday"]
NUMERIC_TOKENS = [
    "income", "salary", "score", "limit", "balance", "amount", "age", "days", "tenure", "count", "pct",
    "percent", "rate", "ratio", "utilization", "utilisation", "months", "years", "loan", "debt",
]
ADDRESS_PART_TOKENS = [
    "city", "state", "zip", "zipcode", "postcode", "postal", "postalcode", "pincode", "pin", "country",
    "province", "county", "town", "region",
]
ID_TOKENS = ["id", "no", "number", "num", "ref", "code", "key", "uuid"]

# Column-name evidence for an identity type, strongest first: (type, whole words, contained text, exact names).
IDENTITY_NAME_RULES = [
    ("email", ["mail"], ["email"], []),
    ("ip", ["ip", "ipv4", "ipv6"], [], ["ipaddress", "ipaddr", "loginip", "signupip"]),
    ("phone",
     ["phone", "mobile", "cell", "cellphone", "msisdn", "telephone", "tel", "landline", "whatsapp"],
     ["phone"], []),
    ("device", ["device", "fingerprint", "imei", "udid"], ["device", "fingerprint"], []),
    ("national_id",
     ["ssn", "sin", "nin", "tin", "pan", "aadhaar", "aadhar", "passport"],
     ["nationalid", "socialsecurity", "taxid"], ["ssnlikeid"]),
    ("bank_account", ["iban", "bic", "swift"], ["bankaccount", "accountnumber", "cardnumber", "routing"], []),
    ("address", ["address", "addr", "street", "addressline", "line1", "line2"], ["address"], []),
]

LINK_FIELDS = {
    "customer_id": ID_NAMES,
    "attribute_type": ["attributetype", "type", "kind", "attributekind", "identifiertype", "linktype"],
    "attribute_value": [
        "attributeid", "attributevalue", "value", "attribute", "identifier", "val", "identifiervalue",
    ],
}
EVENT_FIELDS = {
    "customer_id": ID_NAMES,
    "event_date": [
        "eventdate", "date", "timestamp", "transactiondate", "txndate", "eventtime", "datetime", "time",
        "posteddate", "createdat", "activitydate",
    ],
    "event_type": [
        "eventtype", "type", "transactiontype", "txntype", "category", "event", "activitytype",
    ],
    "utilization": [
        "utilizationpct", "utilization", "utilisation", "util", "utilizationrate", "creditutilization",
        "utilizationpercent",
    ],
    "credit_limit": ["creditlimitattime", "creditlimit", "limit", "cardlimit", "creditline"],
}

TABULAR_FEATURES = ["annual_income", "credit_score", "account_tenure_days"]
NETWORK_FEATURES = [
    "phone_shared_count", "email_shared_count", "address_shared_count", "device_shared_count",
    "network_degree", "shared_attribute_count",
]
TEMPORAL_FEATURES = [
    "total_event_count", "purchase_count", "payment_count", "limit_increase_count", "distinct_event_dates",
    "event_span_days", "events_per_30_days", "max_events_single_day", "max_events_7d",
    "min_days_between_events", "mean_days_between_events", "mean_utilization_pct", "max_utilization_pct",
    "utilization_range", "max_credit_limit",
]
# Behaviour features that need an optional event column.
TEMPORAL_NEEDS = {
    "purchase_count": "event_type",
    "payment_count": "event_type",
    "limit_increase_count": "event_type",
    "mean_utilization_pct": "utilization_pct",
    "max_utilization_pct": "utilization_pct",
    "utilization_range": "utilization_pct",
    "max_credit_limit": "credit_limit_at_time",
}

TYPE_NOUN = {
    "phone": "phone number", "email": "email address", "address": "address", "device": "device",
    "ip": "IP address", "national_id": "national ID", "bank_account": "bank account or card",
    "identifier": "identifier",
}
TYPE_PLURAL = {
    "phone": "phone numbers", "email": "email addresses", "address": "addresses", "device": "devices",
    "ip": "IP addresses", "national_id": "national IDs", "bank_account": "bank accounts or cards",
    "identifier": "identifiers",
}
TYPE_WITH_ARTICLE = {
    "phone": "a phone number", "email": "an email address", "address": "an address", "device": "a device",
    "ip": "an IP address", "national_id": "a national ID", "bank_account": "a bank account or card",
}
FEATURE_LABEL = {
    "annual_income": "Annual income",
    "credit_score": "Credit score",
    "account_tenure_days": "Account age (days)",
    "network_degree": "Linked accounts",
    "shared_attribute_count": "Shared identity links",
    "total_event_count": "Account events",
    "purchase_count": "Purchases",
    "payment_count": "Payments",
    "limit_increase_count": "Credit-limit increases",
    "distinct_event_dates": "Active days",
    "event_span_days": "Activity span (days)",
    "events_per_30_days": "Events per 30 days",
    "max_events_single_day": "Most events in one day",
    "max_events_7d": "Most events in 7 days",
    "min_days_between_events": "Shortest gap between events (days)",
    "mean_days_between_events": "Average gap between events (days)",
    "mean_utilization_pct": "Average utilization",
    "max_utilization_pct": "Peak utilization",
    "utilization_range": "Utilization swing",
    "max_credit_limit": "Highest credit limit",
}

# Sentence parts after "it". {n} is the value as a whole number, {one|many} the word that fits it, {pct} a
# percentage, {points} the value times 100, {v1} one decimal, {num} a number as written for people,
# {kind} the attribute type of a shared-count feature, {label} the feature's label.
CLAUSE = {
    "*_shared_count": "shares {kind} with {n} other {account|accounts}",
    "network_degree": "is linked to {n} other {account|accounts} through shared identity details",
    "shared_attribute_count": "has {n} overlapping identity {link|links} with other accounts",
    "max_utilization_pct": "reached a peak credit utilization of {pct}",
    "mean_utilization_pct": "ran an average credit utilization of {pct}",
    "utilization_range": "had its credit utilization swing by {points} percentage points",
    "max_events_7d": "had at most {n} account {event|events} in any 7-day window",
    "max_events_single_day": "had at most {n} account {event|events} on a single day",
    "events_per_30_days": "averages {v1} account events per 30 days",
    "total_event_count": "has {n} account {event|events} on record",
    "purchase_count": "made {n} {purchase|purchases}",
    "payment_count": "made {n} {payment|payments}",
    "limit_increase_count": "received {n} credit-limit {increase|increases}",
    "distinct_event_dates": "was active on {n} different {day|days}",
    "event_span_days": "has account activity spanning {n} {day|days}",
    "min_days_between_events": "had account events as little as {n} {day|days} apart",
    "mean_days_between_events": "averages {v1} days between account events",
    "max_credit_limit": "reached a credit limit of {num}",
    "annual_income": "reports an annual income of {num}",
    "credit_score": "has a credit score of {num}",
    "account_tenure_days": "has an account that is {n} {day|days} old",
    "*": "has {label} of {num}",
}
# Said instead when the value rounds to zero.
CLAUSE_AT_ZERO = {
    "utilization_range": "kept the same credit utilization throughout",
    "purchase_count": "hasn't made any purchases",
    "payment_count": "hasn't made any payments",
    "limit_increase_count": "hasn't received any credit-limit increases",
}
# Said at zero only where the feature lowered the score; where it raised it, nothing is said.
CLAUSE_AT_ZERO_WHEN_DOWN = {
    "*_shared_count": "doesn't share its {kind} with any other account",
    "network_degree": "isn't linked to any other account",
    "shared_attribute_count": "has no identity details in common with other accounts",
}

SUMMARY = {
    "high": "High risk ({score}/100): flagged because it {ups}.",
    "high_plain": "High risk ({score}/100): flagged by a combination of weaker signals rather than one clear reason.",
    "medium": "Medium risk ({score}/100): worth a look because it {ups}.",
    "medium_plain": "Medium risk ({score}/100): no single strong signal, but several small ones add up.",
    "low": "Low risk ({score}/100): below the alert threshold.",
    "low_unlinked": "Low risk ({score}/100): it isn't linked to any other account and its score is close to that of a typical legitimate customer.",
    "low_plain": "Low risk ({score}/100): no strong fraud signals; its score is close to that of a typical legitimate customer.",
    "favour": " In its favour: it {downs}.",
    "noting": " Still worth noting: it {up}.",
    "ring": " It belongs to suspected ring {ring_id} ({size} linked accounts).",
}
CONTEXT = {
    "suspected": "Part of suspected fraud ring {ring_id}: {size} accounts{linked_by}, {n_high} of them high risk.",
    "group": "In connected group {ring_id} ({size} accounts{linked_by}), which is not currently suspected.",
    "linked_by": " linked by shared {kinds}",
    "one_high": "Its one linked account is rated high risk.",
    "one_not_high": "Its one linked account is not rated high risk.",
    "none_high": "None of its {degree} linked accounts are rated high risk.",
    "some_high": "{high} of its {degree} linked accounts {is_are} rated high risk.",
    "shares": "Shares {kind} with {n} other {account}.",
    "confirmed": "An analyst confirmed this account as fraud.",
    "cleared": "An analyst marked this account as legitimate.",
    "nothing": "No strong signals",
}
RING_TEXT = {
    "opening": "{size} accounts{linked}.",
    "linked": " linked by {parts}",
    "part": "{count} shared {noun}",
    "widest": " One {noun} is used by {members} of them.",
    "risk": " {n_high} of {size} members are rated high risk (average score {score}/100).",
    "opened": " All accounts were opened within {days} days of each other.",
}
