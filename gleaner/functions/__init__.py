"""Column functions: everything that needs one row only and stays inside Catalyst."""
