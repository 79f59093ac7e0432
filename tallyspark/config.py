"""Parameters of the analytics.

The block marked FIXED VALUES holds constants that must equal the source
system's for results to agree (salary table, colour coding, label map, risk
weights and thresholds).  They are stated as plain text in their natural
order.  Everything below it is a tunable of this engine.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source system's for right results)
# ---------------------------------------------------------------------------

# Department -> annual salary (CNY), in the source's order.
DEPARTMENT_SALARIES = [
    ("IT部", 85000),
    ("市场部", 75000),
    ("设计部", 90000),
    ("施工部", 70000),
    ("项目管理部", 95000),
    ("财务部", 80000),
    ("人力资源部", 72000),
    ("采购部", 78000),
    ("质量控制部", 82000),
    ("研发部", 92000),
    ("客户服务部", 68000),
    ("法务部", 88000),
    ("行政部", 65000),
    ("业务发展部", 87000),
]

# Colour of a GS sheet row -> project status.
COLOR_STATUS = [
    ("Green", "Success"),
    ("Dark Green", "Negotiation"),
    ("White", "In Progress"),
    ("Yellow", "Fail"),
]

# GS sheet row numbers (1-based data rows) per colour.
GS_ROW_COLORS = {
    "Green": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20,
              21, 22, 23, 25, 26, 33],
    "White": [24, 30, 35, 37, 38, 39, 40, 41, 42, 43, 44, 46, 48, 49, 50, 51, 52, 53,
              54, 55, 57, 59, 61, 63, 64, 65, 66, 67, 68, 69, 70, 72, 73, 74, 75, 77,
              78, 79, 80, 82, 83, 84, 85, 86, 87, 88, 89, 90, 91, 92, 93, 94, 95, 96,
              97, 98, 99, 100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 110, 111,
              112, 113, 114, 115, 116, 117, 118, 119, 120],
    "Dark Green": [27, 28, 29, 32, 34, 36, 45, 47, 56, 58, 60, 62, 71, 76, 81],
    "Yellow": [31],
}

# Status -> success label (-1 = excluded from training).
SUCCESS_LABELS = [
    ("Success", 1),
    ("Negotiation", 0),
    ("In Progress", -1),
    ("Fail", 0),
    ("Unknown", -1),
]

WORK_HOURS_PER_YEAR = 2080
WORK_HOURS_COLUMNS = ["Date", "Project", "Stage", "Department", "Task", "Hours"]
PROJECT_SHEET_COLUMNS = ["ProjectCode", "ProjectName", "ContractPrice", "PurchaseCost"]
PROJECT_CODE_PATTERN = r"(GS\d+[-\w]*|ISS\d+[-\w]*)"

KEY_DEPARTMENTS = ["设计部", "项目管理部", "施工部", "IT部"]
TIME_WINDOWS = [7, 14, 30]
COST_VARIANCE = 0.3        # |cost ratio - median| threshold
EFFICIENCY_ZSCORE = 3      # |z| threshold
CONTAMINATION = 0.1
N_NEIGHBORS = 20
IFOREST_TREES = 100
IFOREST_MAX_SAMPLES = 256
RANDOM_STATE = 42

RISK_WEIGHTS = [
    ("FinancialRisk", 0.30),
    ("EfficiencyRisk", 0.25),
    ("ComplexityRisk", 0.20),
    ("TimelineRisk", 0.15),
    ("AnomalyRisk", 0.10),
]
# Right-closed bins (0,20] (20,40] (40,60] (60,80] (80,100].
RISK_LEVELS = [
    ("Very Low", 0, 20),
    ("Low", 20, 40),
    ("Medium", 40, 60),
    ("High", 60, 80),
    ("Critical", 80, 100),
]
HIGH_RISK_THRESHOLD = 60
DEFAULT_COST_RATIO = 0.8
FALLBACK_CONTRACT_PRICE = 1000000
FALLBACK_PURCHASE_COST = 800000

# ---------------------------------------------------------------------------
# Engine parameters (not part of the source system)
# ---------------------------------------------------------------------------

# Mapping of the given TPC-H-like tables onto the domain: the
# first 14 brands take the 14 salaries in order; Brand#1..#4 are the key
# departments.
GIVEN_DEPARTMENTS = [f"Brand#{i}" for i in range(1, 15)]
GIVEN_KEY_DEPARTMENTS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]

# Output rounding of registered queries (float sums depend on order).
OUTPUT_DECIMALS = 6
