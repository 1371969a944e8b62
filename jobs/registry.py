"""The jobs as registered queries, with the same in SQL."""

from __future__ import annotations

from jobs.answer_queries import JOB2_SQL, job2_answer_queries
from jobs.refresh_passages import JOB1_SQL, job1_refresh_passages

JOBS = {"job1_refresh_passages": job1_refresh_passages, "job2_answer_queries": job2_answer_queries}
JOBS_SQL = {"job1_refresh_passages": JOB1_SQL, "job2_answer_queries": JOB2_SQL}
