"""The session fixture of the folder above, and the registered queries."""

import cohortry.llm.queries  # noqa: F401
