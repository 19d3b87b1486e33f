"""Fixed values of the ticket work: word lists, patterns, costs and labels that must be exactly these for the results
to be right."""

# ---- intake
BATCH_COLUMNS = ["ticket_id", "channel", "subject", "body", "product"]
REQUIRED_COLUMNS = ["subject", "body", "product", "channel"]
CHANNELS = ["email", "portal", "chat"]
TARGETS = ["category", "priority", "assigned_team", "sentiment"]
PRIORITIES = ["P1", "P2", "P3", "P4"]
SUBMISSION_COLUMNS = ["ticket_id", "category", "priority", "assigned_team", "sentiment", "abstain"]

# ---- costs: (true priority, outcome, cost), and the largest share of hand-offs
COSTS = [("P1", "correct", 0.0), ("P1", "misroute", 8.0), ("P1", "abstain", 1.0),
         ("P2", "correct", 0.0), ("P2", "misroute", 2.0), ("P2", "abstain", 0.5),
         ("P3", "correct", 0.0), ("P3", "misroute", 1.0), ("P3", "abstain", 0.3),
         ("P4", "correct", 0.0), ("P4", "misroute", 1.0), ("P4", "abstain", 0.3)]
MAX_ABSTAIN_RATE = 0.15
P1_THRESHOLD = 0.225
COST_SLACK = 0.002

# ---- guards
MIN_BODY_CHARS = 20
NOVELTY_QUANTILE = 0.995
GUARD_TEXT = {"unknown_product": "product not seen in training",
              "short_body": "empty or very short body (< 20 chars)",
              "novel_topic": "topic unlike any training ticket"}

# ---- severity
SEVERITY_PATTERN = r"(?i)sev\w*\s*:\s*([a-z]+)"
SEVERITY_LEVELS = ["low", "medium", "high", "critical"]
SEVERITY_CUTOFF = 60
SEVERITY_PREFIX = r"(?i)^\s*\[Customer-selected severity:[^\]]*\]\s*"
TAG_PATTERN = r"(?i)\[[^\]]*sev\w*\s*:\s*(\w+)\]"

# ---- sentence normalising
SENTENCE_SPLIT = r"(?<=[.!?])\s+|\]\s*"
EMAIL_PATTERN = r"\S+@\S+"
ID_PATTERN = r"\b[a-z]+[-_][a-z0-9-]*\d[a-z0-9-]*\b"
USER_PATTERN = r"\b[a-z]+\.[a-z]+\b"
NUMBER_PATTERN = r"\d+(?:[.:,/x-]\d+)*"
STRIP_CHARACTERS = " .,;:!?\"'[]()"
SLANG = [(r"\br\b", "are"), (r"\btmrw\b", "tomorrow"), (r"\bu\b", "you"), (r"\bw/", "with "), (r"\bpls\b", "please")]
TEMPLATE_MIN_TICKETS = 20
TEMPLATE_CUTOFF = 90

# ---- impact factors: per factor, ordered levels with their templates; a template with a bracket or backslash is a pattern
FACTOR_TEMPLATES = {
    "scope": {
        "wide": ["all customers on the platform see this", "every branch is affected", "the whole site is affected",
                 r"all \d+ users in the company are impacted"],
        "few": [r"about \d+ users are affected", "a few teams are impacted", "several vms on it are affected",
                r"\b\d+ hosts see this"],
        "single": ["only one user is affected", "just this one server", "single device, nothing else",
                   "it's only me as far as i can tell", r"\bonly [a-z0-9-]*\d+ is affected"],
        "none": ["no impact on users at the moment", "only the staging cluster is affected"],
    },
    "environment": {
        "production": ["this box runs our production erp", "it hosts our core banking vms",
                       "production workloads run on it", "it is part of the live payments cluster",
                       "it serves the live e-commerce site", "customer-facing services run on this system",
                       r"\bthis is prod\b", r"this is the primary system at [^.]+"],
        "golive": ["go-live is tomorrow morning"],
        "nonprod": ["it is in our test environment", "this is a lab unit", "spare unit in the lab, not in service yet",
                    "this is the dr standby, not active right now", "only the staging cluster is affected"],
    },
    "workaround": {
        "failover": ["traffic failed over to the secondary, so we're limping along"],
        "slow": ["there is a manual workaround but it is slow", "still no fix, and the workaround is painful"],
        "have": ["we have a workaround for now"],
    },
    "deescalation": {
        "yes": [r"(?<![a-z])not urgent(?: at all)?(?![a-z])", "low priority, just curious",
                "not a big deal, just flagging it", "our manager flagged it as urgent, but honestly it can wait"],
    },
    "urgency_claim": {
        "yes": [r"(?<!not )(?<![a-z])urgent\s*[.!]", "need this fixed asap", "marking this urgent",
                "please treat as urgent"],
    },
}
FACTOR_DEFAULTS = {"scope": "unknown", "environment": "unknown", "workaround": "none_mentioned", "deescalation": "no",
                   "urgency_claim": "no"}
FACTOR_LEVELS = {
    "scope": ["wide", "few", "single", "none", "unknown"],
    "environment": ["production", "golive", "nonprod", "unknown"],
    "workaround": ["failover", "slow", "have", "none_mentioned"],
    "severity_tag": ["none", "low", "medium", "high", "critical"],
    "urgency_claim": ["yes", "no"],
    "deescalation": ["yes", "no"],
}
FACTOR_FUZZY_CUTOFF = 90
FACTOR_FUZZY_MIN_LENGTH = 15
FACTOR_FUZZY_LENGTH_SHARE = 0.85

# ---- counterfactual edits
LOW_SCOPE = ["Just this one server.", "Single device, nothing else.", "Only one user is affected.",
             "It's only me as far as I can tell."]
HIGH_SCOPE = ["All customers on the platform see this.", "Every branch is affected.", "The whole site is affected."]
PRODUCTION = ["This box runs our production ERP.", "It hosts our core banking VMs.", "Production workloads run on it.",
              "It is part of the live payments cluster.", "It serves the live e-commerce site.",
              "Customer-facing services run on this system.", "this is prod"]
PRODUCTION_PATTERN = r"This is the primary system at [^.]+\."
EDIT_TEXT = {
    "scope_up": "All customers on the platform see this.", "scope_down": "Only one user is affected.",
    "environment_down": "It is in our test environment.", "workaround": "There is a manual workaround but it is slow.",
    "tone_only": "This is unacceptable.", "urgency_claim": "Marking this urgent.",
}
EDIT_ABSENT = {"workaround": "workaround|limping", "tone_only": "unacceptable", "urgency_claim": "urgent"}

# ---- labels of a partner's signals, as shown
SIGNAL_LABELS = {
    "lines_per_month_6m": "Order lines per month (6 m)", "active_month_share_6m": "Months with orders (6 m)",
    "days_since_last_order": "Days since last order", "typical_gap_days": "Typical days between orders",
    "att_avg_4q": "Target attainment (4 q)", "n_products_2q": "Product families (2 q)",
    "margin_pct_4q": "Margin % (4 q)", "rev_cv_6m": "Revenue volatility (CV, 6 m)",
    "tenure_months": "Months since onboarding",
}
