"""DataFrame operators from detection to reports."""
