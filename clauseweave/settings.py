"""Thresholds, taxonomy, label maps and word lists.

Everything in this module has to equal the published behaviour for results to
be comparable, so it is stated plainly and kept in one place.
"""

from __future__ import annotations

# --- Text and segmentation -------------------------------------------------
MIN_CLAUSE_WORDS = 10
MAX_CLAUSE_CHARS = 15000
MIN_SEGMENTS_BY_HEADER = 5
MIN_FILING_WORDS = 100
MIN_EXHIBIT_CHARS = 200

# --- Labels and splits -----------------------------------------------------
MAX_LABELS_PER_CLAUSE = 3
MIN_TYPE_COUNT_FOR_EVAL = 10
MIN_HELD_OUT_COUNT = 2
AUTO_LABEL_SHARE_OF_TRAIN = 0.40
SEED = 42
OTHER = "Other"
AUTO_SOURCE_PREFIX = "EDGAR"

# --- Probabilities ---------------------------------------------------------
AUTO_ACCEPT_CONFIDENCE = 0.80
UNKNOWN_MAX_PROBABILITY = 0.3
DEFAULT_CLASS_THRESHOLD = 0.5
THRESHOLD_GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
TEMPERATURE_GRID = [
    0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2,
    1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0,
]
PROBABILITY_EPSILON = 1e-7
WINDOW_TOKENS = 254
WINDOW_OVERLAP = 128

# --- Power imbalance -------------------------------------------------------
WEIGHT_SENTIMENT = 0.30
WEIGHT_MODAL = 0.25
WEIGHT_OBLIGATION = 0.25
WEIGHT_ASSERTIVENESS = 0.20
NEUTRAL_SCORE = 0.5
SENTIMENT_SCORES = {"negative": 0.0, "neutral": 0.5, "positive": 1.0}
IMBALANCE_HIGH = 40
IMBALANCE_MEDIUM = 20

# --- Anomalies -------------------------------------------------------------
FOREST_WEIGHT = 0.5
RECONSTRUCTION_WEIGHT = 0.5
ANOMALY_FLAG_ABOVE = 70
FOREST_TREES = 200
FOREST_SAMPLE_ROWS = 256
FOREST_CONTAMINATION = 0.05
NETWORK_HIDDEN = [256, 64]
NETWORK_PASSES = 30
PROXY_SHORT_WORDS = 15
PROXY_LONG_QUANTILE = 0.95

# --- Clusters and taxonomy growth ------------------------------------------
MIN_CLUSTER_SIZE = 10
NEIGHBOURS = 15
NEIGHBOUR_TREES = 6
NEIGHBOUR_ROUNDS = 8
KEYWORDS_PER_CLUSTER = 10
ROUTE_HIGH_SIMILARITY = 0.80
ROUTE_LOW_SIMILARITY = 0.50
AUTO_ADD_MIN_SIZE = 10
REVIEW_MIN_SIZE = 10

# --- Lexical word lists ----------------------------------------------------
OBLIGATION_WORDS = ["shall", "must", "will", "required", "obligated"]
DISCRETION_WORDS = ["may", "might", "could", "should", "permitted", "entitled"]
PARTY_A_TERMS = [
    "company", "licensor", "seller", "vendor", "provider", "employer",
    "franchisor", "licenser", "lessor", "grantor", "party a", "first party",
    "we", "our",
]
PARTY_B_TERMS = [
    "counterparty", "licensee", "buyer", "customer", "employee", "franchisee",
    "lessee", "grantee", "party b", "second party", "you", "your",
]
ABSOLUTE_TERMS = [
    "shall", "must", "will", "never", "always", "in no event",
    "under no circumstances", "absolutely", "strictly", "solely",
    "exclusively", "immediately", "forthwith",
]
CONDITIONAL_TERMS = [
    "if", "unless", "provided that", "subject to", "contingent", "depending",
    "except", "notwithstanding", "may", "might", "could", "should",
    "where applicable",
]
PARTY_A_QUOTED = ["Company", "Licensor", "Seller", "Vendor", "Provider", "Employer", "Franchisor"]
PARTY_A_PLAIN = ["Company", "Licensor", "Seller", "Vendor", "Provider"]
PARTY_B_QUOTED = ["Counterparty", "Licensee", "Buyer", "Customer", "Employee", "Franchisee"]
PARTY_B_PLAIN = ["Counterparty", "Licensee", "Buyer", "Customer"]
NAME_STOPS = [
    "the", "a", "an", "of", "in", "to", "and", "or", "for", "is", "are", "be",
    "such", "as", "by", "any", "all", "with",
]
UNNAMED_TYPE = "Unknown Clause Type"

# --- Taxonomy: 100 clause types in order -----------------------------------
CLAUSE_TYPES = [
    "Competitive Restriction Exception", "Non-Compete", "Exclusivity",
    "No-Solicit Of Customers", "No-Solicit Of Employees", "Non-Disparagement",
    "Termination For Convenience", "Rofr/Rofo/Rofn", "Change Of Control",
    "Anti-Assignment", "Revenue/Profit Sharing", "Price Restrictions",
    "Minimum Commitment", "Volume Restriction", "IP Ownership Assignment",
    "Joint IP Ownership", "License Grant", "Non-Transferable License",
    "Affiliate License-Licensor", "Affiliate License-Licensee",
    "Unlimited/All-You-Can-Eat-License", "Irrevocable Or Perpetual License",
    "Source Code Escrow", "Post-Termination Services", "Audit Rights",
    "Uncapped Liability", "Cap On Liability", "Liquidated Damages",
    "Warranty Duration", "Insurance", "Covenant Not To Sue",
    "Third Party Beneficiary", "Most Favored Nation", "Governing Law",
    "Dispute Resolution", "Limitations Of Liability", "Indemnification",
    "Agreement Date", "Effective Date", "Expiration Date", "Renewal Term",
    "Confidentiality", "Amendments", "Anti-Corruption Laws",
    "Approvals And Consents", "Authority", "Compliance With Laws",
    "Consent To Jurisdiction", "Definitions", "Enforceability",
    "Entire Agreements", "Expenses", "Force Majeure", "Further Assurances",
    "Interests", "Liens And Encumbrances", "Limitations Of Remedies",
    "Non-Waiver", "Notices", "Organization And Existence", "Payments",
    "Representations And Warranties", "Sanctions",
    "Securities Law Compliance", "Severability", "Specific Performance",
    "Successors And Assigns", "Survival", "Taxes And Withholding",
    "Trade Controls", "Transactions With Affiliates", "Waiver Of Jury Trial",
    "Waivers", "No-Shop", "Material Adverse Effect", "Hell-Or-High-Water",
    "Termination Fee", "Reverse Termination Fee", "Matching Rights",
    "Superior Offer Definition", "Fiduciary Exception",
    "Antitrust Efforts Standard", "Operating Covenants",
    "Expense Reimbursement", "Intervening Event Definition",
    "Board Recommendation Change", "Tail Period",
    "Data Protection And Privacy", "Employment And Benefits",
    "Capitalization", "Publicity And Announcements",
    "Non-Solicitation General", "Step-In Rights", "Benchmarking Rights",
    "Electronic Signatures And Counterparts", "Service Level Agreement",
    "Subcontracting", "Assignment Of Receivables", "Performance Bonds",
    "Escrow And Holdback",
]

# --- Provision label -> taxonomy name (None: too generic, row is skipped) ----
PROVISION_LABELS = {
    "Adjustments": None,
    "Agreements": None,
    "Amendments": "Amendments",
    "Anti-Corruption Laws": "Anti-Corruption Laws",
    "Approvals": "Approvals And Consents",
    "Arbitration": "Dispute Resolution",
    "Assignments": "Anti-Assignment",
    "Authority": "Authority",
    "Base Salary": "Employment And Benefits",
    "Benefits": "Employment And Benefits",
    "Capitalization": "Capitalization",
    "Closings": None,
    "Compliance With Laws": "Compliance With Laws",
    "Confidentiality": "Confidentiality",
    "Consent To Jurisdiction": "Consent To Jurisdiction",
    "Construction": "Definitions",
    "Definitions": "Definitions",
    "Disability": "Employment And Benefits",
    "Effective Dates": "Effective Date",
    "Employment": "Employment And Benefits",
    "Enforceability": "Enforceability",
    "Entire Agreements": "Entire Agreements",
    "Erisa": "Employment And Benefits",
    "Expenses": "Expenses",
    "Further Assurances": "Further Assurances",
    "General": None,
    "Governing Laws": "Governing Law",
    "Headings": None,
    "Indemnifications": "Indemnification",
    "Insurances": "Insurance",
    "Integration": "Entire Agreements",
    "Intellectual Property": "IP Ownership Assignment",
    "Interests": "Interests",
    "Jurisdictions": "Consent To Jurisdiction",
    "Liens": "Liens And Encumbrances",
    "Limitations Of Remedies": "Limitations Of Remedies",
    "Non-Waivers": "Non-Waiver",
    "Notices": "Notices",
    "No Third-Party Beneficiaries": "Third Party Beneficiary",
    "Obligations": None,
    "Organization": "Organization And Existence",
    "Payments": "Payments",
    "Remedies": "Limitations Of Remedies",
    "Representations": "Representations And Warranties",
    "Sanctions": "Sanctions",
    "Securities Laws": "Securities Law Compliance",
    "Severability": "Severability",
    "Specific Performance": "Specific Performance",
    "Successors": "Successors And Assigns",
    "Survival": "Survival",
    "Taxes": "Taxes And Withholding",
    "Terminations": "Termination For Convenience",
    "Titles": None,
    "Trade Controls": "Trade Controls",
    "Transactions With Affiliates": "Transactions With Affiliates",
    "Transfers": "Anti-Assignment",
    "Waiver Of Jury Trial": "Waiver Of Jury Trial",
    "Waivers": "Waivers",
    "Warranties": "Representations And Warranties",
    "Withholding": "Taxes And Withholding",
}

# --- Deal-point question keyword -> taxonomy name, first match wins ----------
DEAL_POINT_KEYWORDS = [
    ("reverse termination fee", "Reverse Termination Fee"),
    ("termination fee", "Termination Fee"),
    ("hell-or-high-water", "Hell-Or-High-Water"),
    ("no-shop", "No-Shop"),
    ("non-solicitation", "No-Shop"),
    ("fiduciary", "Fiduciary Exception"),
    ("operating covenant", "Operating Covenants"),
    ("mae", "Material Adverse Effect"),
    ("material adverse effect", "Material Adverse Effect"),
    ("antitrust", "Antitrust Efforts Standard"),
    ("specific performance", "Specific Performance"),
    ("superior offer", "Superior Offer Definition"),
    ("intervening event", "Intervening Event Definition"),
    ("matching right", "Matching Rights"),
    ("tail period", "Tail Period"),
    ("expense reimbursement", "Expense Reimbursement"),
    ("board recommendation", "Board Recommendation Change"),
    ("change of recommendation", "Board Recommendation Change"),
    ("change in recommendation", "Board Recommendation Change"),
]
