"""The engine façade and the registered queries."""
