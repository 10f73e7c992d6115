"""Column and expression helpers; everything here returns a Column."""
