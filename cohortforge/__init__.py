"""Spark jobs for cohort building, signature scoring and survival analysis.

Every verb takes DataFrames and returns DataFrames, keyed by ``cohort_id`` (and
its own keys), so one job serves one cohort or thousands.
"""
