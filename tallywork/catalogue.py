"""The built-in evaluation questions.

`keyword_groups`: every group must match, any keyword of a group does. `expected_keywords`: any keyword does. `min_relevant`: fewer labels give a
warning. `max_relevant`: labels kept per question (40 where absent).
"""

EVAL_QUERIES = [
    {"id": "q1", "category": "exact", "query": "Registered Nurse jobs", "keyword_groups": [["registered nurse", "rn"]], "min_relevant": 20},
    {
        "id": "q2",
        "category": "semantic",
        "query": "mental health therapy positions",
        "keyword_groups": [["mental health", "therapy", "counseling", "behavioral health", "psychiatric"]],
        "min_relevant": 15,
    },
    {
        "id": "q3",
        "category": "filtering",
        "query": "healthcare jobs in Colorado",
        "keyword_groups": [
            ["nurse", "therapist", "medical", "clinical", "physician", "paramedic", "health"],
            ["colorado", "denver", "aurora", "fort collins", "boulder", "loveland", "lakewood"],
        ],
        "min_relevant": 5,
    },
    {
        "id": "q4",
        "category": "aggregation",
        "query": "what medical and clinical roles are available",
        "expected_keywords": [
            "nurse", "physician", "therapist", "paramedic", "dentist", "surgeon", "pharmacist", "clinical", "radiologist",
        ],
        "min_relevant": 10,
        "max_relevant": 40,
    },
    {
        "id": "q5",
        "category": "noisy",
        "query": "jobs helping sick people get better",
        "keyword_groups": [["nurse", "therapist", "medical", "patient", "clinical", "health", "hospital", "care"]],
        "min_relevant": 15,
    },
    {
        "id": "q6",
        "category": "exact",
        "query": "CDL A Truck Driver",
        "keyword_groups": [["cdl", "cdl-a", "cdl a"], ["driver", "driving", "truck"]],
        "min_relevant": 10,
    },
    {
        "id": "q7",
        "category": "semantic",
        "query": "commercial vehicle and freight jobs",
        "keyword_groups": [["commercial", "freight", "logistics", "truck", "transport", "cargo", "cdl", "regional"]],
        "min_relevant": 5,
    },
    {
        "id": "q8",
        "category": "filtering",
        "query": "delivery driver jobs in Texas",
        "keyword_groups": [
            ["driver", "delivery", "cdl", "shopper", "courier"],
            ["texas", "san antonio", "houston", "dallas", "austin", "bexar", "travis", "guadalupe"],
        ],
        "min_relevant": 3,
    },
    {
        "id": "q9",
        "category": "aggregation",
        "query": "types of driving and delivery jobs",
        "expected_keywords": ["driver", "cdl", "delivery", "instacart", "shopper", "regional", "courier", "trucking"],
        "min_relevant": 10,
        "max_relevant": 40,
    },
    {
        "id": "q10",
        "category": "noisy",
        "query": "jobs that involve driving around",
        "keyword_groups": [["driver", "driving", "cdl", "delivery", "transport", "shopper"]],
        "min_relevant": 10,
    },
    {
        "id": "q11",
        "category": "exact",
        "query": "Houseparents residential care",
        "keyword_groups": [["houseparents", "house parents"]],
        "min_relevant": 10,
    },
    {
        "id": "q12",
        "category": "semantic",
        "query": "residential youth care positions",
        "keyword_groups": [["youth", "residential", "caregiver", "youth development", "youth specialist"]],
        "min_relevant": 8,
    },
    {
        "id": "q13",
        "category": "filtering",
        "query": "youth care jobs requiring relocation",
        "keyword_groups": [["youth", "houseparent", "house parent", "residential"], ["relocation", "relocate"]],
        "min_relevant": 8,
    },
    {
        "id": "q14",
        "category": "aggregation",
        "query": "types of youth and social service roles",
        "expected_keywords": [
            "houseparent", "youth development", "residential", "caregiver", "specialist", "counselor", "mentor",
        ],
        "min_relevant": 8,
        "max_relevant": 30,
    },
    {
        "id": "q15",
        "category": "noisy",
        "query": "jobs working with kids in a group home",
        "keyword_groups": [["youth", "children", "kids", "residential", "houseparent", "house parent", "caregiver"]],
        "min_relevant": 8,
    },
]
