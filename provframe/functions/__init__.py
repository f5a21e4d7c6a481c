"""Column expressions over witnesses, and their text form."""
