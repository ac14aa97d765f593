"""Row contracts between the stages. DDL strings, so that readers never infer a schema."""

RAW_JOB = (
    "source_id STRING, source STRING, title STRING, company STRING, location STRING, description STRING, "
    "url STRING, job_type STRING, is_remote BOOLEAN, min_salary INT, max_salary INT, logo STRING, "
    "keywords ARRAY<STRING>"
)
RAW_JOB_COLUMNS = [part.split()[0] for part in RAW_JOB.split(", ")]

JOB = (
    "id STRING, source_id STRING, source STRING, title STRING, company STRING, location STRING, "
    "description STRING, url STRING, job_type STRING, is_remote BOOLEAN, min_salary INT, max_salary INT, "
    "content_hash STRING, summary STRING, salary STRING, responsibilities ARRAY<STRING>, "
    "requirements ARRAY<STRING>, benefits ARRAY<STRING>, skills ARRAY<STRING>, logo STRING, "
    "fetched_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"
)
JOB_COLUMNS = [part.split()[0] for part in JOB.split(", ")]

CHUNK = (
    "id STRING, job_id STRING, chunk_type STRING, chunk_text STRING, embedding_model STRING, "
    "embedding_version INT, created_at TIMESTAMP_NTZ, embedding ARRAY<FLOAT>"
)
CHUNK_COLUMNS = [part.split()[0] for part in CHUNK.split(", ")]

FAVORITE = "user_id STRING, job_id STRING, saved_at TIMESTAMP_NTZ"

PARSED_RESUME = (
    "STRUCT<name: STRING, email: STRING, linkedin: STRING, phone: STRING, location: STRING, summary: STRING, "
    "skills: ARRAY<STRING>, "
    "experience: ARRAY<STRUCT<company: STRING, title: STRING, start_date: STRING, end_date: STRING, "
    "description: STRING>>, "
    "education: ARRAY<STRUCT<institution: STRING, degree: STRING, field: STRING, graduation_year: STRING>>, "
    "certifications: ARRAY<STRING>>"
)
RESUME = (
    "id STRING, user_id STRING, file_path STRING, raw_text STRING, "
    f"parsed_data {PARSED_RESUME}, embedding_model STRING, embedding ARRAY<FLOAT>, "
    "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)

PARSED_JOB = (
    "STRUCT<summary: STRING, salary: STRING, responsibilities: ARRAY<STRING>, requirements: ARRAY<STRING>, "
    "benefits: ARRAY<STRING>, skills: ARRAY<STRING>, job_type: STRING, is_remote: BOOLEAN>"
)

EVAL_QUERY = (
    "id STRING, category STRING, query STRING, expected_keywords ARRAY<STRING>, "
    "keyword_groups ARRAY<ARRAY<STRING>>, min_relevant INT, max_relevant INT, position INT"
)
JUDGMENT = "judge STRING, query_id STRING, job_id STRING, verdict STRING"
RUN = "version BIGINT, fetched BIGINT, stored BIGINT, skipped BIGINT"
EMBEDDING_CACHE = "text_hash STRING, model STRING, embedding ARRAY<FLOAT>, cached_at TIMESTAMP_NTZ"

REMOTIVE_PAGE = (
    "jobs ARRAY<STRUCT<id: BIGINT, url: STRING, title: STRING, company_name: STRING, job_type: STRING, "
    "candidate_required_location: STRING, salary: STRING, description: STRING>>"
)
JOBICY_PAGE = (
    "jobs ARRAY<STRUCT<id: BIGINT, url: STRING, jobTitle: STRING, companyName: STRING, jobType: VARIANT, "
    "jobGeo: STRING, jobDescription: STRING, salaryMin: DOUBLE, salaryMax: DOUBLE, salaryPeriod: STRING, "
    "salaryCurrency: STRING>>"
)
FINDWORK_PAGE = (
    "count BIGINT, next STRING, previous STRING, results ARRAY<STRUCT<id: STRING, role: STRING, "
    "company_name: STRING, company_num_employees: INT, employment_type: STRING, location: STRING, "
    "remote: BOOLEAN, logo: STRING, url: STRING, text: STRING, date_posted: STRING, "
    "keywords: ARRAY<STRING>, source: STRING>>"
)

CSV_IN = (
    "sourceId STRING, source STRING, title STRING, company STRING, location STRING, description STRING, "
    "url STRING, jobType STRING, minSalary STRING, maxSalary STRING"
)
