"""Appointment and booking analytics as Spark DataFrame operators."""
