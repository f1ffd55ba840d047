"""Common words that look like a name (they begin with a surname's syllable): our own vocabulary, by field, and classes that rules build.

It is a start, not a dictionary: users add the words of their field by `stop_words` of detect().
"""

from __future__ import annotations

from veilspark.functions.lexicon import REGIONS

MEASURE_AND_TIME = (
    "이번 이때 이전 이후 이상 이하 이내 이래 이외 이미 이제 이것 이곳 이런 오전 오후 오늘 어제 현재 지난 추후 차후 장래 장기 주간 연간 연도 금년 전년 전월 전회 기간 기한 기일 "
    "백만 천만 전체 전부 전원 전액 최고 최고액 최근 최대 최대한 최소 최소한 최종 최초 최선 여러 여기 모두 하나 나머지 우선 주로 반드시 함께 전반 제반 상당 상시"
).split()
COURT = (
    "신청 신문 심리 심판 심사 심의 소송 소장 소명 소외 소외인 공소 공소외 공시 공탁 공판 공증 선고 선임 선정 송달 변론 변호 변제 주문 주장 주위적 예비적 인용 인정 인도 원심 원본 조서 조사 조정 진술 진정 "
    "기각 기록 기소 기재 고소 고발 고지 고의 전심 제소 제기 제출 정본 명령 명시 명확 석방 구속 구형 구상 유죄 유치 임의 위법 위반 위임 손해 손실 배상 배당 이의 이유 이송 국선 문언 어음 지연 집행 신빙성"
).split()
CONTRACT = (
    "임대 임대차 임차 임금 임원 전세 전대 전용 전보 지분 지급 지체 지참 차용 차액 차임 차입 원금 원리금 예금 예약 예정 금액 금전 금원 금융 금지 양도 양수 양육 양육비 양측 양자 양쪽 소유 소유권 소재 소비 소득 소속 "
    "유효 유증 유언 유산 유상 유예 유지 성립 용역 용도 용지 공사 공급 공유 공제 도급 도입 하도 하도급 하자 하수급 경매 설정 설립 기여 변경 추심 추가 추인 추정 채권 채무 채용 연대 연체 이자 이익 이행 이혼 노임 주식 주주 신탁 신용 금고"
).split()
ADMINISTRATION = (
    "정부 정책 정보 정리 정당 정산 정정 정지 정확 정도 정답 정신 정치 조례 조직 조치 조회 조항 조건 조합 조합비 조성 민원 민사 민간 주민 주소 주택 주거 주의 주요 주관 위원 위원회 위탁 위치 위험 지방 지역 지정 지시 지원 지침 지위 지부 지출 "
    "국가 국민 국내 국외 국회 국세 공무 공문 공개 공고 공단 공동 공익 공정 공공 도시 도로 구역 구분 구성 구성원 구체 구제 구매 구조 고시 고용 고유 고려 허가 허용 허위 인가 인원 인근 인수 인계 인상 안건 안내 예산 예외 예방 연구 연금 연락 연장 "
    "표시 표결 표준 표현 제도 제한 제공 제외 제안 제정 기관 기업 기준 기타 기본 반대 반영 반환 방법 방식 방안 방문 방향 방지 추진 설명 설비 설치 경과 경우 경위 경찰 경제 현장 현황 차량 차이 차원 진행 진단 진료 전화 전입 문서 문의 문제 문항 문화 문안 "
    "성명 성별 성격 성과 서류 서면 서명 서식 서비스 신고 신분 강제 강조 강화 강력 이사 이사회 이사장 이메일 이메 이용 이름 사내 등기 등록 마감 마련 염두 석유 여부 원인 원칙 남녀 남성 우편 나이 왕래 육성 한편 한도 권리 권한 황당 홍수"
).split()
DEPARTMENTS = "총무 기획 인사 재무 회계 세무 법무 노무 홍보 영업 구매 자재 생산 품질 설계 시공 감리 안전 보건 환경 전산 연구 개발 교육 운영 관리 비서 시설 물류 경영 경비 조달 상담 자문 고문 국선 선임 수석 책임 전문 상근 상임 전임 주무 겸임 촉탁 파견".split()

#: People by their part; each also with 들.
PEOPLE = (
    "조합원 회원 위원 직원 사원 임원 주민 국민 시민 학생 고객 손님 하객 유족 가족 자녀 근로자 사용자 사업자 사업주 소비자 투자자 위탁자 수탁자 수익자 참석자 피해자 관계인 이해관계인 상속인 신청인 변호인 대리인 채권자 채무자 당사자 원고 피고 제삼자 제3자"
).split()
#: Offices whose head is named with 장, and titles with 님.
OFFICES = "시 군 구청 청 서 원 부서 조달청 경찰서 세무서 교육장 지청 지원".split()
TITLES = "원장 사장 회장 위원장 대표 부장 과장 팀장".split()
#: Stems of words in 적 and in 성.
ADJECTIVES = "구체 객관 주관 실질 형식 종국 확정 최종 고의 예비 주위 일반 전반".split()
QUALITIES = "정당 정확 유효 위법 적법 관련 필요 공정 임의 고의".split()

# Cities, counties and districts by their public list, those that begin like a surname or are often named alone.
TOWNS = (
    "서울 부산 대구 인천 광주 대전 울산 세종 경기 강원 충북 충남 전북 전남 경북 경남 제주 강남 강동 강북 강서 관악 광진 구로 금천 노원 도봉 동작 마포 서대문 서초 성동 성북 송파 양천 용산 은평 종로 중랑 "
    "고양 광명 구리 군포 김포 남양주 성남 수원 안산 안성 안양 양주 양평 여주 연천 오산 용인 의정부 이천 파주 평택 포천 하남 화성 강릉 고성 양구 양양 원주 인제 정선 홍천 제천 진천 청주 충주 공주 금산 서산 서천 천안 태안 홍성 "
    "고창 김제 남원 임실 전주 정읍 진안 고흥 나주 목포 순천 여수 영광 장성 장흥 진도 함평 경산 경주 고령 구미 김천 문경 봉화 성주 안동 예천 경산 거제 김해 남해 밀양 양산 진주 통영 하동 함안 함양"
).split()


def common_words() -> list[str]:
    """All of the above, with what follows from rules: people in the plural, heads of offices, provinces without their last syllable, districts by direction."""
    plain = [*MEASURE_AND_TIME, *COURT, *CONTRACT, *ADMINISTRATION, *DEPARTMENTS, *PEOPLE, *TOWNS]
    made = [f"{w}들" for w in [*PEOPLE, "이", "그"]] + [f"{w}장" for w in OFFICES] + ["도지사"] + [f"{w}님" for w in TITLES]
    made += [f"{w}적" for w in ADJECTIVES] + [f"{w}성" for w in QUALITIES]
    made += [w for r in REGIONS for w in (r, r[:-1]) if len(w) <= 4] + [f"{w}구" for w in "동서남북중"]
    return list(dict.fromkeys(plain + made))


COMMON_WORDS = common_words()
