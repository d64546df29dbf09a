"""Fixed values.

Everything in this file has to equal the published value for a report to give
the right answer: list prices, unit sizes, look-back defaults' building blocks,
event names, message texts and the service-account pattern. They are stated
here once, plainly, and used by name elsewhere.
"""

# Byte units.
KIB = 1024
MIB = 1024**2
GIB = 1024**3
TIB = 1024**4

# Minimum billed per query on the on-demand model: 10 MiB.
MIN_BILLED_BYTES = 10 * MIB

# Autoscaler step in slots, and its one-minute minimum in milliseconds.
AUTOSCALE_STEP = 50
MIN_BILLED_MS = 60_000

# Milliseconds per reporting unit.
UNIT_MS = {
    "millisecond": 1,
    "second": 1_000,
    "minute": 60_000,
    "hour": 3_600_000,
    "day": 86_400_000,
}

# Time zone in which look-backs and civil buckets are counted by default.
DEFAULT_TZ = "America/Los_Angeles"

# On-demand price per TiB: the current and the previous list price.
ON_DEMAND_PER_TIB = 6.25
ON_DEMAND_PER_TIB_LEGACY = 5.0

# Slot-hour prices per edition and commitment.
STANDARD_PAYG = 0.04
ENTERPRISE_PAYG = 0.06
ENTERPRISE_1Y = 0.048
ENTERPRISE_3Y = 0.036
ENTERPRISE_PLUS_PAYG = 0.10
ENTERPRISE_PLUS_1Y = 0.08
ENTERPRISE_PLUS_3Y = 0.06

# Storage prices per GiB and month (logical is the same in both multi-regions).
ACTIVE_LOGICAL = 0.02
LONG_TERM_LOGICAL = 0.01
ACTIVE_PHYSICAL_US = 0.04
LONG_TERM_PHYSICAL_US = 0.02
ACTIVE_PHYSICAL_EU = 0.044
LONG_TERM_PHYSICAL_EU = 0.022

# Storage prices per GiB and hour.
ACTIVE_LOGICAL_HOURLY = 0.000027397
LONG_TERM_LOGICAL_HOURLY = 0.000013699
ACTIVE_PHYSICAL_HOURLY = 0.000054795
LONG_TERM_PHYSICAL_HOURLY = 0.000027397

# Slot baselines tried by the total billing report.
BASELINES = (0, 50, 100, 200, 500, 1000)

# Plans of the per-query billing report, as its recommendations name them.
PLAN_STANDARD = "Standard Edition"
PLAN_ENTERPRISE = "Enterprise Edition"
PLAN_ENTERPRISE_1Y = "Enterprise Edition 1 Year Commit"
PLAN_ENTERPRISE_3Y = "Enterprise Edition 3 Year Commit"
PLAN_ENTERPRISE_PLUS = "Enterprise Plus Edition"
PLAN_ENTERPRISE_PLUS_1Y = "Enterprise Plus Edition 1 Year Commit"
PLAN_ENTERPRISE_PLUS_3Y = "Enterprise Plus Edition 3 Year Commit"

# Points of the on-demand and the flat-rate score, if a test holds and if not.
DEMAND_PER_COST = 100
DEMAND_IF_QUERY = (100, 200)
DEMAND_IF_LONG = (100, 200)
DEMAND_IF_MANY_SLOTS = (500, 100)
DEMAND_MANY_SLOTS = 500
DEMAND_PER_REPEATED_COST = -0.1
DEMAND_IF_OTHER_KIND = (100, 0)
FLAT_PER_COST = 125
FLAT_IF_QUERY = (200, 100)
FLAT_IF_LONG = (200, 100)
FLAT_IF_MANY_SLOTS = (100, 500)
FLAT_MANY_SLOTS = 200
FLAT_PER_REPEATED_COST = 0.1
LONG_RUN_MS = 60_000

# Audit event names and the job type each stands for.
EVENT_TYPES = {
    "query_job_completed": "QUERY",
    "load_job_completed": "LOAD",
    "extract_job_completed": "EXTRACT",
    "table_copy_job_completed": "TABLE COPY",
}
EVENT_SUFFIX = "_job_completed"
SCRIPT_CHILD_LIKE = "script_job_%"

# Service accounts of the BI tool.
LOOKER_ACCOUNT = (
    "[a-zA-Z0-9._%+-]*looker[a-zA-Z0-9._%+-]*"
    "@[a-zA-Z0-9-]+.iam.gserviceaccount.com"
)

# Texts of the dataset storage report.
KEEP_LOGICAL = "Do nothing as logical storage is the best option (currently logical)."
KEEP_PHYSICAL = "Do nothing as physical storage is the best option (currently physical)."
GO_PHYSICAL = "Change dataset to physical storage for additional savings."
GO_LOGICAL = (
    "Dataset is currently using physical storage and costing you more money than "
    "logical storage. Change dataset back to logical storage."
)
SET_LOCATION = "SET @@location = '<location>';\n"
SET_PHYSICAL = "ALTER SCHEMA `<dataset>` SET OPTIONS(storage_billing_model = 'PHYSICAL')"
SET_LOGICAL = "ALTER SCHEMA `<dataset>` SET OPTIONS(storage_billing_model = 'LOGICAL')"
