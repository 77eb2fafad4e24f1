"""All registered queries."""

from checks import (  # noqa: F401
    access_checks,
    calendar_checks,
    cleanse_checks,
    flagship,
    hierarchy_checks,
    infer_checks,
    ingest_checks,
    log_checks,
    model_checks,
    profile_checks,
    relate_checks,
    typed_checks,
    utility_checks,
    versioned_checks,
)
from checks.common import ORACLE, QUERIES  # noqa: F401
