"""Sources and sinks: driver-table adapters, landing-zone files, Bronze."""
