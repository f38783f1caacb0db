"""Plans: named streams wired together, request/response functions, and plans from plain data."""
