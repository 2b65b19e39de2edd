"""Operators bound to the driver's tables, each with an independent SQL oracle where SQL can say it."""
