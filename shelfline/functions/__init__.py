"""Column, date, window and join helpers shared by the operators."""
