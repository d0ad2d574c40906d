"""Record schemas of raw and canonical tables."""

from pyspark.sql import types as T

_s, _l, _i, _ts = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


RAW_FLOW = _struct(
    rec_id=_l, start_time=_ts, end_time=_ts, obfuscated_a=_s, obfuscated_b=_s, address_a=_s, address_b=_s,
    port_a=_i, port_b=_i, bytes_a_to_b=_l, bytes_b_to_a=_l, transport_protocol=_i,
)
RAW_DNS = _struct(
    rec_id=_l, ts=_ts, obfuscated_src=_s, obfuscated_dst=_s, src_ip=_s, dest_ip=_s, src_port=_i, dst_port=_i,
    protocol=_i, opcode=_i, resultcode=_i, host=_s,
    response_addresses=T.ArrayType(_s), response_ttls=T.ArrayType(_s),
)
FLOW = _struct(
    flow_id=_l, start_ts=_ts, end_ts=_ts, user_id=_s, dest_ip=_s, user_port=_i, dest_port=_i,
    bytes_up=_l, bytes_down=_l, protocol=_i,
)
PEER_FLOW = _struct(
    flow_id=_l, start_ts=_ts, end_ts=_ts, user_a=_s, user_b=_s, a_port=_i, b_port=_i,
    bytes_a_to_b=_l, bytes_b_to_a=_l, protocol=_i,
)
NO_USER_FLOW = _struct(
    flow_id=_l, start_ts=_ts, end_ts=_ts, ip_a=_s, ip_b=_s, a_port=_i, b_port=_i,
    bytes_a_to_b=_l, bytes_b_to_a=_l, protocol=_i,
)
DNS_RESPONSE = _struct(
    dns_id=_l, ts=_ts, user_id=_s, dns_server=_s, user_port=_i, server_port=_i, protocol=_i, opcode=_i,
    resultcode=_i, domain_name=_s, ip_address=_s, ttl=_i,
)
TRANSACTION = _struct(
    txn_id=_l, ts=_ts, kind=_s, user_id=_s, dest_user_id=_s, amount_bytes=_l, amount_idr=_l,
)
