"""Column helpers: text folding, rounding, timecodes."""
