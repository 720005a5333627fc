"""Column functions: everything here is a Catalyst expression, nothing runs Python on executors."""
