"""From a table to a report: which checks run, the score, and the registered queries."""
