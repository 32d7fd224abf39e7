"""Collection reports, one module per question."""
