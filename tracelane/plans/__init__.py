"""Complete analyses composed from the operators, and the driver-table adapter."""
