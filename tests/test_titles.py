from pyspark.sql import functions as F

from postmill.functions.titles import classify_title, resolve_level, title_level

CATEGORIES = {
    "machine_learning_engineer": ["Machine Learning Engineer II", "Machine Learning Engineer, YouTube"],
    "software_engineer": ["Software Engineer", "Software Engineer, Siri", "Backend Engineer", "Data Engineer",
                          "Full-Stack Engineer"],
    "data_scientist": ["Data Scientist, Retail Analytics", "Research Scientist - Foundation Models", "Applied Scientist"],
    "manager": ["Software Engineering Manager II", "Data Science Manager", "Senior Engineering Manager"],
    None: ["Product Manager", "Technical Program Manager", "Program Manager", "Designer", "UX Designer", "", None],
}

LEVELS = [
    ("Software Engineering Intern", None, "intern"),
    ("Junior Software Engineer", None, "junior"),
    ("Mid-Level Software Engineer", None, "mid"),
    ("Senior Software Engineer", None, "senior"),
    ("Senior Staff Software Engineer", None, "staff"),
    ("Senior Principal Engineer", None, "principal"),
    ("Senior Director, Engineering", None, "director"),
    ("Senior Distinguished Engineer", None, "distinguished"),
    ("Senior Fellow", None, "fellow"),
    ("", None, "mid"),
    (None, None, "mid"),
    ("Engineer I", "amazon", "junior"),
    ("Engineer 1", "Amazon ", "junior"),
    ("SDE II", "amazon", "mid"),
    ("Applied Scientist 2", "amazon", "mid"),
    ("Engineer III", "amazon", "senior"),
    ("Engineer II", "google", "junior"),
    ("Engineer III", "google", "mid"),
    ("Engineer IV", "google", "senior"),
    ("IC2 Engineer", "microsoft", "junior"),
    ("IC3 Engineer", "microsoft", "mid"),
    ("IC4 Engineer", "microsoft", "senior"),
    ("IC5 Engineer", "microsoft", "principal"),
    ("IC6 Engineer", "microsoft", "principal"),
    ("Engineer 2", "microsoft", "mid"),
    ("Scientist III", "microsoft", "senior"),
    ("IC2 II", "microsoft", "junior"),
    ("Engineer L3", "netflix", "junior"),
    ("Engineer L4", "netflix", "mid"),
    ("Engineer (L5)", "netflix", "senior"),
    ("Engineer L4/L5", "netflix", "mid"),
    ("Engineer II", "apple", "mid"),
    ("Engineer II", "meta", "mid"),
]


def test_categories(rows):
    cases = [(title, category) for category, titles in CATEGORIES.items() for title in titles]
    assert rows("t string, w string", cases, classify_title(F.col("t"))) == [c for _, c in cases]


def test_levels(rows):
    got = rows("t string, c string, w string", LEVELS, title_level(F.col("t"), F.col("c")))
    assert got == [level for *_, level in LEVELS]


def test_upstream_level_is_kept_when_known(rows):
    cases = [(" Staff ", "Senior Engineer"), ("boss", "Senior Engineer"), ("", "Engineer")]
    got = rows("l string, t string", cases, resolve_level(F.col("l"), F.col("t"), F.lit("meta")))
    assert got == ["staff", "senior", "mid"]
