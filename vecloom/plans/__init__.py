"""Query language, planner, and the registered queries."""
